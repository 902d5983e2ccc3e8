"""Message delivery as a stream: routing, handling, publishing, bounded retry.

Questions are acknowledged late: a micro-batch is handled and published before its
offsets are committed, so a crash repeats it. Ingest requests are acknowledged early:
the batch only hands them to a work folder, and the work happens after the commit, at
most once. Outputs are written below the batch number, so a repeated batch replaces its
own output.
"""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorebase import fixed
from lorebase.functions import events
from lorebase.sources import queue

Handler = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Routes:
    """Folders of one worker."""

    inbox: str
    results: str
    accepted: str
    checkpoint: str


def with_timeout(work: Callable[[], None], seconds: float) -> None:
    """Run the jobs of ``work`` and cancel them when they take too long."""
    from pyspark import SparkContext

    sc, tag = SparkContext.getOrCreate(), f"delivery-{id(work)}"

    def tagged() -> None:
        sc.addJobTag(tag)
        try:
            work()
        finally:
            sc.removeJobTag(tag)

    pool = concurrent.futures.ThreadPoolExecutor(max_workers=1)
    running = pool.submit(tagged)
    try:
        running.result(timeout=seconds)
    except concurrent.futures.TimeoutError:
        sc.cancelJobsWithTag(tag)
        raise TimeoutError(f"pipeline timed out after {seconds:g}s") from None
    finally:
        pool.shutdown(wait=False)


def decided(handled: DataFrame, max_deliveries: int) -> DataFrame:
    """Adds ``decision`` to rows with (kind, error, retry_count): done, retry, publish_error or drop."""
    failed = F.col("error").isNotNull() | (F.col("kind") == events.ERROR)
    return handled.withColumn(
        "decision",
        F.when(~failed, "done").otherwise(
            events.failed_delivery(F.col("retry_count"), F.col("kind") != events.ERROR, max_deliveries)
        ),
    )


def _outbound(rows: DataFrame, result) -> DataFrame:
    response = F.struct(result.alias("result"))
    body = events.envelope(response, F.col("kind"), events.parse_query(F.col("body")))
    return rows.select("message_id", body.alias("body"), F.lit("result").alias("routing_key"))


def process_batch(
    batch: DataFrame,
    batch_id: int,
    routes: Routes,
    plugin_type: str,
    handler: Handler,
    max_deliveries: int = fixed.MAX_DELIVERIES,
    timeout: float = fixed.PIPELINE_TIMEOUT,
) -> None:
    """Handle one micro-batch. ``handler`` maps (message_id, body, ...) to (message_id, result, error)."""
    spark = batch.sparkSession
    routed = batch.withColumn("kind", events.route(F.col("body"), F.lit(plugin_type)))
    routed = routed.persist()
    try:
        queue.publish(
            routed.filter(events.is_ingest(F.col("kind"))).select("message_id", "body", "kind", F.lit("ingest").alias("routing_key")),
            routes.accepted, batch_id,
        )
        questions = routed.filter(F.col("kind") == events.QUERY)
        scratch = f"{routes.results}-handled/batch={batch_id}"
        try:
            with_timeout(lambda: handler(questions).select("message_id", "result", "error").write.mode("overwrite").parquet(scratch), timeout)
            answers = spark.read.schema("message_id string, result string, error string").parquet(scratch)
        except Exception as exc:  # the whole batch failed: every question of it counts as failed
            text = f"Error: handler {exc}" if isinstance(exc, TimeoutError) else f"Error: {exc}"
            answers = questions.select("message_id", F.lit(None).cast("string").alias("result"), F.lit(text).alias("error"))
        outcome = decided(routed.filter(~events.is_ingest(F.col("kind"))).join(answers, "message_id", "left"), max_deliveries)
        done = _outbound(outcome.filter("decision = 'done'"), F.col("result"))
        reported = _outbound(outcome.filter("decision = 'publish_error'"), F.col("error"))
        queue.publish(done.unionByName(reported), routes.results, batch_id)
        again = outcome.filter("decision = 'retry'")
        try:
            queue.republish(again, routes.inbox, batch_id)
        except Exception:  # what cannot be tried again is reported at once
            queue.publish(_outbound(again, F.coalesce("error", "result")), f"{routes.results}-unretried", batch_id)
    finally:
        routed.unpersist()


def start(
    spark: SparkSession, routes: Routes, plugin_type: str, handler: Handler, max_deliveries: int = fixed.MAX_DELIVERIES,
    timeout: float = fixed.PIPELINE_TIMEOUT, available_now: bool = False, files_per_batch: int = 1,
) -> StreamingQuery:
    writer = queue.read_stream(spark, routes.inbox, files_per_batch).writeStream.option("checkpointLocation", routes.checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(
        lambda df, n: process_batch(df, n, routes, plugin_type, handler, max_deliveries, timeout)
    ).start()


def run_accepted(
    spark: SparkSession, routes: Routes, batch_id: int, work: Handler, timeout: float = fixed.PIPELINE_TIMEOUT
) -> None:
    """The work of early-acknowledged requests: (message_id, body, kind) -> (message_id, result, error).

    A failure becomes a published error; there is no retry, as the request is acknowledged.
    """
    accepted = spark.read.schema("message_id string, body string, kind string").json(f"{routes.accepted}/batch={batch_id}")
    try:
        scratch = f"{routes.results}-accepted/batch={batch_id}"
        with_timeout(lambda: work(accepted).select("message_id", "result", "error").write.mode("overwrite").parquet(scratch), timeout)
        done = spark.read.schema("message_id string, result string, error string").parquet(scratch)
        outcome = done.select("message_id", F.coalesce("result", F.col("error")).alias("result"))
        sent = _outbound(accepted.join(outcome, "message_id", "left"), F.col("result"))
        queue.publish(sent, f"{routes.results}-ingest", batch_id)
    except Exception as exc:
        sent = _outbound(accepted, F.lit(f"Error: {exc}"))
        queue.publish(sent, f"{routes.results}-ingest", batch_id)


def stop(query: StreamingQuery, grace_seconds: int = 30) -> bool:
    """Let the running micro-batch finish within the grace period."""
    query.stop()
    return bool(query.awaitTermination(grace_seconds))


def health(query: StreamingQuery) -> dict:
    """Readiness of a worker: active and without a failure."""
    failure = query.exception()
    return {
        "status": "ready" if query.isActive and failure is None else "not_ready",
        "checks": {"stream": "connected" if query.isActive else "disconnected", "error": str(failure) if failure else None},
        "message": query.status["message"],
    }
