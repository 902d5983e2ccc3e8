"""Evaluation runs: answer every case, score it, keep failures apart, aggregate, store, compare."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.text import ellipsis, run_id
from lorebase.operators import evaluation
from lorebase.session import checkpoint

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    id: str
    cases: DataFrame
    aggregate: DataFrame
    counts: DataFrame


def new_run_id(spark: SparkSession, label: str | None) -> str:
    """UTC time stamp, with the label in file-name form."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return spark.range(1).select(run_id(utc, F.lit(label).cast("string"))).first()[0]


def score_cases(cases: DataFrame, invoke: Step, score: Step) -> DataFrame:
    """Cases with answers, scores or an error.

    ``invoke``: (index, question, ...) -> (index, pipeline_answer, retrieved_contexts, invoke_error).
    ``score``: answered cases -> (index, the four metrics, score_error). A case whose
    scoring fails keeps its answer and its contexts.
    """
    answered = checkpoint(cases.join(invoke(cases), "index", "left"))
    scores = checkpoint(score(answered.filter(F.col("invoke_error").isNull())))
    joined = answered.join(scores.select("index", "score_error", *fixed.METRICS), "index", "left")
    failed = F.coalesce("invoke_error", "score_error")
    metrics = {m: F.when(failed.isNull(), evaluation.finite(F.col(m))) for m in fixed.METRICS}
    return joined.withColumns(metrics).withColumn("error", failed).drop("invoke_error", "score_error")


def evaluate(cases: DataFrame, invoke: Step, score: Step, label: str | None = None) -> Run:
    scored = checkpoint(score_cases(cases, invoke, score))
    aggregate = evaluation.aggregate(evaluation.long_scores(scored.filter("error IS NULL"), ["index"]), [])
    return Run(new_run_id(cases.sparkSession, label), scored, aggregate, evaluation.outcome_counts(scored, []))


def write_run(run: Run, folder: str, plugin_type: str, label: str | None = None) -> str:
    """``<folder>/<id>/summary`` with one JSON row, and ``<folder>/<id>/cases`` with one row per case."""
    means = run.aggregate.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("metric", F.struct("mean", "median", "min", "max"))))).alias("aggregate"))
    summary = run.counts.join(means).select(
        F.lit(run.id).alias("id"), F.lit(plugin_type).alias("plugin_type"), F.lit(label).cast("string").alias("label"),
        F.col("cases").alias("test_case_count"), F.col("succeeded").alias("success_count"), F.col("failed").alias("failure_count"), "aggregate",
    )
    target = f"{folder}/{run.id}"
    run.cases.write.json(f"{target}/cases")
    summary.write.json(f"{target}/summary")
    return target


SUMMARY = (
    "id string, plugin_type string, label string, test_case_count long, success_count long, failure_count long, "
    "aggregate map<string, struct<mean: double, median: double, min: double, max: double>>"
)


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Newest run first, with the mean of each metric; a metric that a run lacks counts 0."""
    runs = spark.read.schema(SUMMARY).json(f"{folder}/*/summary")
    means = [F.coalesce(F.try_element_at("aggregate", F.lit(m))["mean"], F.lit(0.0)).alias(m) for m in fixed.METRICS]
    return runs.select("id", "plugin_type", "test_case_count", *means).orderBy(F.desc("id"))


def compare_runs(spark: SparkSession, folder: str, baseline: str, current: str) -> DataFrame:
    runs = spark.read.schema(SUMMARY).json([f"{folder}/{baseline}/summary", f"{folder}/{current}/summary"])
    means = runs.select("id", F.explode("aggregate").alias("metric", "a")).select("id", "metric", F.col("a.mean").alias("mean"))
    return evaluation.compare(means.filter(F.col("id") == baseline), means.filter(F.col("id") == current))


def failure_lines(cases: DataFrame) -> DataFrame:
    """One line per failed case, for the report."""
    return cases.filter(F.col("error").isNotNull()).select("index", F.concat(
        F.lit("  ["), F.col("index"), F.lit('] "'), ellipsis(F.col("question"), 40), F.lit('" — '), F.col("error")).alias("line"))


def summary_lines(aggregate: DataFrame) -> DataFrame:
    """The metric table of a report, one line per metric."""
    return aggregate.select("metric", F.format_string("  %-22s%8.3f%8.3f%8.3f%8.3f", "metric", "mean", "median", "min", "max").alias("line"))


def comparison_lines(deltas: DataFrame) -> DataFrame:
    sign = F.when(F.col("absolute_delta") >= 0, "+").otherwise("")
    pct_sign = F.when(F.col("percentage_change") >= 0, "+").otherwise("")
    return deltas.select("metric", F.concat(
        F.format_string("%-22s%10.3f%10.3f", "metric", "baseline", "current"), sign, F.format_string("%9.3f", "absolute_delta"),
        pct_sign, F.format_string("%8.1f%%", "percentage_change")).alias("line"))
