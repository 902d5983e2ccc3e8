"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts, each range is sorted (Spark's
sort spills), equal texts lie next to each other, and a full comparison with the
neighbour above decides where a run of equal texts begins. The range key is short (the
first characters and a 64-bit hash), so that the sampled splitters stay small however
long the texts are; the order inside a range goes by the whole text.

A text that many rows share is cut into slices (see ``hot_slices``). A slice is sorted by
itself; the heads of its runs, one row per run, are sorted and compared once more.

Nulls: a null text counts as empty. Rows without doc_id take part; they never give the
smallest id unless all rows of the group lack one. Rows that agree in text and doc_id:
one of them stays. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import BLANKS, hot_slices, text_of, written


def exact_groups(docs: DataFrame, lead: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    normal = F.regexp_replace(text_of(), BLANKS, " ")
    rows = docs.select("doc_id", normal.alias("_text")).withColumns(
        {"_lead": F.substring("_text", 1, lead), "_hash": F.xxhash64("_text")}
    )
    hot = F.broadcast(hot_slices(rows.select("_hash", F.length("_text").alias("_size")), ["_hash"], F.col("_size")))
    slice_no = F.pmod(F.xxhash64("doc_id"), F.col("slices"))
    sliced = rows.join(hot, "_hash", "left").withColumn("_slice", F.coalesce(slice_no, F.lit(0)).cast("int"))
    ranged = sliced.repartitionByRange("_lead", "_hash", "_slice")

    near = ["_lead", "_hash", "_slice"]
    order = Window.partitionBy(*near).orderBy("_text", F.asc_nulls_last("doc_id"))
    begins = F.coalesce(F.lag("_text").over(order) != F.col("_text"), F.lit(True))
    runs = ranged.withColumn("_begins", begins).withColumn(
        "_run", F.sum(F.col("_begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    run = Window.partitionBy(*near, "_run")
    local = written(
        runs.select(
            "doc_id", *near, "_run", "_begins",
            F.sha2("_text", 256).alias("text_sha256"),
            F.when(F.col("_begins") & F.col("slices").isNotNull(), F.col("_text")).alias("_head"),
        ).withColumns({"_least": F.min("doc_id").over(run), "_n": F.count("*").over(run)}),
        "exact-runs",
    )
    # The runs of sliced texts: at most one for each slice, and there are few slices.
    ahead = Window.partitionBy("_lead", "_hash").orderBy("_head", F.asc_nulls_last("_least"))
    heads = local.filter(F.col("_head").isNotNull()).withColumn(
        "_new", F.coalesce(F.lag("_head").over(ahead) != F.col("_head"), F.lit(True)).cast("int")
    ).withColumn("_group", F.sum("_new").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("_lead", "_hash", "_group")
    merged = heads.select(
        *near, "_run", F.min("_least").over(whole).alias("_whole_least"), F.sum("_n").over(whole).alias("_whole_n"), F.lit(True).alias("_cut")
    )
    keep = F.when(F.col("_cut"), F.col("_whole_least")).otherwise(F.col("_least"))
    return local.join(F.broadcast(merged), [*near, "_run"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_whole_n", "_n").alias("group_size"),
        (F.col("_begins") & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )
