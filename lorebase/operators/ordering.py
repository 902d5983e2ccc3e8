"""Running sums and positions that split a group over many tasks.

A window without a partition key, or with a hot one, runs in a single task. Here the
order key is cut into ranges by approximate quantiles; the ranges are summed with
map-side combining, the range totals (at most ``ranges`` per group) are accumulated,
and the rows of each range add their own running sum. The result is exact for any
choice of cut points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import broadcast_measured, checkpoint


def _range_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_of(cuts: Column, value: Column, ranges: int) -> Column:
    """Number of cut points <= value, by halving steps."""
    step = 1 << (ranges.bit_length() - 1)
    steps = []
    while step:
        steps.append(F.lit(step))
        step >>= 1

    def advance(at: Column, by: Column) -> Column:
        inside = (at + by <= F.size(cuts)) & (F.get(cuts, at + by - 1) <= value)
        return F.when(F.coalesce(inside, F.lit(False)), at + by).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), advance)


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    value: str,
    out: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` by numeric ``order`` within ``group``.

    ``order`` must be unique within a group. An empty ``group`` means the whole table.
    """
    ranges = ranges or _range_count(df)
    fractions = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    quantiles = F.percentile_approx(order, fractions, F.lit(max(1000, 10 * ranges)))
    if group:
        cuts = checkpoint(df.groupBy(*group).agg(quantiles.alias("_cuts")))
        cuts = broadcast_measured(cuts, 8 * ranges + 1024)  # a kilobyte for the key
        ranged = df.join(cuts, list(group)).withColumn("_range", _range_of(F.col("_cuts"), F.col(order), ranges)).drop("_cuts")
    else:
        group = ["_all"]
        points = df.agg(quantiles).first()[0] or []  # as many numbers as there are ranges
        literal = F.array(*[F.lit(p) for p in points]) if points else F.array().cast("array<double>")
        ranged = df.withColumn("_all", F.lit(0)).withColumn("_range", _range_of(literal, F.col(order), ranges))
    group = list(group)
    totals = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, [*group, "_range"])
        .withColumn(out, F.col("_offset") + F.sum(value).over(within))
        .drop("_range", "_offset", "_all")
    )


def positions(df: DataFrame, group: Sequence[str], order: str, out: str = "position", ranges: int | None = None) -> DataFrame:
    """Add ``out``: the 0-based position by ``order`` within ``group``."""
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("long")), group, order, "_one", out, ranges)
    return counted.withColumn(out, F.col(out) - 1).drop("_one")


def sorted_positions(df: DataFrame, group: str, order: str, out: str = "position", ranges: int | None = None) -> DataFrame:
    """0-based position by any sortable ``order``: a range shuffle, range sizes, position within the range.

    The range of every row is checkpointed as data, so that a rerun of a lost task cannot
    draw other range limits.
    """
    ranges = ranges or _range_count(df)
    ranged = checkpoint(df.repartitionByRange(ranges, group, order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_range").orderBy(order)
    return (
        ranged.join(offsets, [group, "_range"])
        .withColumn(out, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_range", "_offset")
    )


def batch_number(df: DataFrame, order: str, size: int, out: str = "batch_no") -> DataFrame:
    return positions(df, [], order, "_pos").withColumn(out, F.floor(F.col("_pos") / size)).drop("_pos")


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Interpolating median per group, from counts of distinct values and their running sum.

    No task holds all values of a group, as the exact percentile aggregate would.
    """
    group = list(group)
    counts = checkpoint(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n")))
    upto = running_sum(counts, group, value, "_n", "_upto")
    size = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    low = F.floor((F.col("_size") + 1) / 2)
    high = F.floor((F.col("_size") + 2) / 2)

    def holds(rank: Column) -> Column:
        return (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)

    middle = upto.join(size, group).filter(holds(low) | holds(high))
    return middle.groupBy(*group).agg(
        ((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias(out)
    )
