"""Statistics over scored cases and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.operators.ordering import exact_median


def finite(score: Column) -> Column:
    """NaN, infinities and missing scores become 0."""
    inf = F.lit(float("inf"))
    bad = score.isNull() | F.isnan(score) | (score == inf) | (score == -inf)
    return F.when(bad, F.lit(0.0)).otherwise(score)


def long_scores(cases: DataFrame, keys: list[str], metrics: tuple[str, ...] = fixed.METRICS) -> DataFrame:
    """One row per case and metric; missing scores are left out."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return cases.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) as (metric, score)").filter(F.col("score").isNotNull())


def aggregate(scores: DataFrame, keys: list[str]) -> DataFrame:
    """mean, median, min and max of ``score`` per key and metric."""
    groups = [*keys, "metric"]
    basics = scores.groupBy(*groups).agg(
        F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("*").alias("n_scored")
    )
    return basics.join(exact_median(scores, groups, "score"), groups)


def outcome_counts(cases: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.col("error").isNotNull()
    return cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed")
    )


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Deltas of the metrics that both aggregates have."""
    b = baseline.select("metric", F.col("mean").alias("baseline"))
    c = current.select("metric", F.col("mean").alias("current"))
    delta = F.col("current") - F.col("baseline")
    pct = F.when(F.col("baseline") == 0, F.lit(0.0)).otherwise(delta / F.col("baseline") * 100)
    return b.join(c, "metric").select("metric", "baseline", "current", delta.alias("absolute_delta"), pct.alias("percentage_change"))


def verdict(deltas: DataFrame) -> DataFrame:
    return deltas.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("absolute_delta") > 0).alias("improved"),
        F.count_if(F.col("absolute_delta") < 0).alias("regressed"),
    )


def duration_parts(seconds: Column) -> tuple[Column, Column]:
    return F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int")
