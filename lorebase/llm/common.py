"""What the operators share: the shared folder, written tables, hot keys, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Runs of white space between words, as a pattern for Java and RE2.
BLANKS = r"[\x20\x09-\x0D]+"
#: A side is broadcast only after its rows were counted, and only up to this many bytes.
BROADCAST_BYTES = 48 << 20


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that the cluster shares (spark.checkpoint.dir).

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "lorebase-shared")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Tables written by the steps at work, innermost last.
_steps: list[list[DataFrame]] = []


def written(df: DataFrame, purpose: str, outlasts: bool = False) -> DataFrame:
    """The table written as Parquet to the shared folder and read again.

    It cuts the lineage, so that a lost executor costs a read and not the work before it. The
    files go when the step ends that wrote them (:func:`step`; ``outlasts``: the step around
    it), else when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    around = _steps[: len(_steps) - outlasts]
    if around:
        around[-1].append(table)
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a written table whose successor is written."""
    target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
    target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def step() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that outlast it."""
    _steps.append([])
    try:
        yield
    finally:
        for table in _steps.pop():
            discard(table)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_slices(df: DataFrame, key: Sequence[str], bytes_of: Column | None = None) -> DataFrame:
    """Keys that would fill a large part of a task, with the number of slices to cut them into.

    A key is hot if it has over 1/(4 P) of the rows or of the bytes, with P shuffle
    partitions. So there are at most 8 P hot keys whatever the data: small enough to
    broadcast by proof. Cutting a key into ``slices`` leaves 1/(4 P) in each.
    """
    share = 4 * partitions(df.sparkSession)
    size = F.sum(bytes_of if bytes_of is not None else F.lit(1))
    totals = Observation()
    seen = df.observe(totals, F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("b"))
    counts = written(seen.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), size.alias("_b")).filter("_n > 1"), "key-counts")
    if counts.isEmpty():  # no key has two rows, or there are no rows, of which nothing is observed
        return counts.select(*key, F.lit(1).alias("slices"))
    n, b = max(totals.get["n"], 1), max(totals.get["b"], 1)
    part = F.greatest(F.col("_n") / F.lit(n), F.col("_b") / F.lit(b))
    return counts.filter(part * share > 1).select(*key, F.ceil(part * share).cast("int").alias("slices"))


def measured(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint after counting; beyond the limit the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))
