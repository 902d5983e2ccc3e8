"""From neighbours to a prompt context: thresholds, per-source choice, budget, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.text import ordered_lines
from lorebase.session import broadcast_limit, broadcast_measured, materialised


def with_documents(neighbours: DataFrame, store: DataFrame) -> DataFrame:
    """Fetch text and metadata for the winners only, on their ids.

    The winners are written first and their ids measured. Within the broadcast limit the ids
    meet the store's scan, and the few texts they find, measured too, meet the winners: no
    text of another row leaves its task.
    """
    winners = materialised(neighbours)
    asked = broadcast_measured(winners.select("collection", "id").distinct(), 120)
    payload = materialised(store.select("collection", "id", "document", "metadata").join(asked, ["collection", "id"], "left_semi"))
    size = payload.agg(F.coalesce(F.sum(F.octet_length("document") + 300), F.lit(0))).first()[0]
    payload = F.broadcast(payload) if size <= broadcast_limit(store.sparkSession) else payload
    return winners.join(payload, ["collection", "id"])


def score(distance: Column) -> Column:
    """1 - distance; a missing distance scores 0."""
    return F.coalesce(1.0 - distance, F.lit(0.0))


def passing(results: DataFrame, min_score: float) -> DataFrame:
    """Threshold filter; a kept row without a distance gets distance 1."""
    return (
        results.withColumn("score", score(F.col("distance")))
        .filter(F.col("score") >= min_score)
        .withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    )


def best_per_source(results: DataFrame, collection_order: Column) -> DataFrame:
    """Keep the best row per source of a question; rows without a source are all kept.

    Equal scores keep the order of the collections and then of the ranks.
    """
    order = [F.desc("score"), collection_order.asc(), F.col("rank").asc()]
    surrogate = F.concat(F.lit("\0"), F.col("collection"), F.lit("\0"), F.col("rank"))
    keyed = results.withColumn(
        "_key", F.when(F.coalesce("source", F.lit("")) == "", surrogate).otherwise(F.col("source"))
    )
    best = keyed.withColumn("_best", F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(*order)))
    kept = best.filter(F.col("_best") == 1).drop("_best", "_key")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def within_budget(results: DataFrame, budget: int, position: str = "position", text: str = "document") -> DataFrame:
    """The longest leading run of a question's rows whose raw lengths fit the budget.

    A question has at most n rows here, so the window is bounded. Lengths are never
    negative, hence the running sum is monotone and the filter cuts a prefix.
    """
    upto = Window.partitionBy("query_id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("_upto", F.sum(F.length(text)).over(upto)).filter(F.col("_upto") <= budget).drop("_upto")


def numbered(position: Column, text: Column) -> Column:
    return F.concat(F.lit("[source:"), position.cast("string"), F.lit("] "), text)


def contexts(results: DataFrame, separator: str) -> DataFrame:
    """One prompt context per question."""
    return results.groupBy("query_id").agg(
        ordered_lines(F.col("position"), numbered(F.col("position"), F.col("document")), separator).alias("context")
    )


def guidance_results(
    results: DataFrame,
    collection_order: Column,
    n: int = fixed.N_RESULTS,
    min_score: float = fixed.MIN_SCORE,
    budget: int = fixed.CONTEXT_CHARS,
) -> DataFrame:
    """Union of the collections' results -> sort, threshold, best per source, top n, budget.

    A source that the metadata lacks counts as the collection's name; an empty one
    stays empty and is never merged.
    """
    sourced = results.withColumn("source", F.coalesce("metadata.source", "collection"))
    chosen = best_per_source(passing(sourced, min_score), collection_order).filter(F.col("position") < n)
    return within_budget(chosen, budget)


def expert_results(
    results: DataFrame,
    min_score: float = fixed.MIN_SCORE,
    budget: int = fixed.CONTEXT_CHARS,
) -> DataFrame:
    """One collection's results -> threshold, numbering in store order, budget."""
    in_order = Window.partitionBy("query_id").orderBy("rank")
    kept = passing(results, min_score).withColumn("position", F.row_number().over(in_order) - 1)
    return within_budget(kept, budget)


def first_per_source(results: DataFrame) -> DataFrame:
    """Source references of an expert answer: the first row per source, blanks merged."""
    key = F.coalesce("metadata.source", F.lit(""))
    first = Window.partitionBy("query_id", "_key").orderBy("position")
    kept = results.withColumn("_key", key).withColumn("_first", F.row_number().over(first)).filter(F.col("_first") == 1)
    return kept.select(
        "query_id",
        "position",
        F.coalesce("metadata.chunkIndex", F.col("position")).cast("int").alias("chunk_index"),
        F.col("metadata.embeddingType").alias("embedding_type"),
        F.col("metadata.documentId").alias("document_id"),
        F.col("_key").alias("source"),
        F.col("metadata.title").alias("title"),
        F.col("metadata.type").alias("type"),
        (1.0 - F.col("distance")).alias("score"),
        F.coalesce(F.nullif(F.col("metadata.uri"), F.lit("")), F.col("_key")).alias("uri"),
    )
