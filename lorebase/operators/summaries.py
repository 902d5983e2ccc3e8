"""Map and tree-reduce summaries with pluggable model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.models import ModelPorts
from lorebase.functions.text import is_blank, ordered_lines
from lorebase.operators.ordering import positions
from lorebase.operators.packing import pack_sections
from lorebase.session import broadcast_measured, checkpoint


def map_budget(n: Column, max_length: int) -> Column:
    """Length budget of one map call: the whole length for a single chunk, else a share with a floor."""
    share = F.floor(F.lit(max_length) / F.greatest(F.lit(2), n)).cast("int")
    return F.when(n == 1, F.lit(max_length)).otherwise(F.greatest(F.lit(fixed.MAP_FLOOR_CHARS), share))


def _largest(chunks: DataFrame, keys: list[str]) -> int:
    return chunks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def reduce_levels(n: int, fanin: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanin), levels + 1
    return levels


def map_reduce(
    chunks: DataFrame,
    keys: list[str],
    index: str,
    text: str,
    ports: ModelPorts,
    max_length: int = fixed.SUMMARY_CHARS,
    fanin: int = fixed.SUMMARY_FANIN,
    bounded: bool = True,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """One ``summary`` per key: every chunk is mapped, then merged ``fanin`` neighbours at a time.

    Failed or empty maps are left out and the order is kept; a failed merge falls back to
    the joined inputs. Each level groups at most ``fanin`` rows, so the depth is
    logarithmic and no task holds a whole key. ``bounded=False`` numbers the survivors of
    a key in parallel, for keys that are not single documents. ``materialise`` can write
    or checkpoint the model output of each level, so that a lost executor repeats no call.
    """
    if fanin < 2:
        raise ValueError("fanin must be >= 2")
    sizes = chunks.groupBy(*keys).agg(F.count("*").alias("_n"))
    mapped = (
        chunks.join(sizes, keys)
        .withColumn("_text", ports.map_text(F.col(text), map_budget(F.col("_n"), max_length)))
        .filter(F.coalesce(F.col("_text"), F.lit("")) != "")
        .select(*keys, F.col(index).cast("long").alias("_at"), "_text")
    )
    mapped = materialise(mapped)
    if bounded:
        in_order = Window.partitionBy(*keys).orderBy("_at")
        level = mapped.withColumn("_at", (F.row_number().over(in_order) - 1).cast("long"))
    else:
        level = positions(mapped, keys, "_at", "_pos").drop("_at").withColumnRenamed("_pos", "_at")
    for _ in range(reduce_levels(_largest(chunks, keys), fanin)):
        groups = level.groupBy(*keys, F.floor(F.col("_at") / fanin).alias("_at")).agg(
            F.count("*").alias("_members"),
            ordered_lines(F.col("_at"), F.col("_text"), fixed.SECTION_SEPARATOR).alias("_joined"),
        )
        asked = F.when(F.col("_members") > 1, F.col("_joined"))
        merged = ports.reduce_text(asked, F.lit(max_length))
        level = groups.select(*keys, "_at", F.coalesce(merged, F.col("_joined")).alias("_text"))
        level = materialise(level)
    return level.select(*keys, F.col("_text").alias("summary"))


def join_only(texts: Column, budgets: Column) -> Column:
    """Reduce port that merges by concatenation: the fallback of a failed merge, for every merge."""
    return F.when(budgets > 0, texts)


def call_plan(chunks: DataFrame, keys: list[str], fanin: int = fixed.SUMMARY_FANIN) -> DataFrame:
    """(keys, level, n_in, calls, n_out) of every reduce level, from the chunk counts alone."""
    if fanin < 2:
        raise ValueError("fanin must be >= 2")
    sizes = chunks.groupBy(*keys).agg(F.count("*").alias("n_in"))
    depth = reduce_levels(_largest(chunks, keys), fanin)
    levels = []
    for level in range(1, depth + 1):
        n_in = F.ceil(F.col("n_in") / F.pow(F.lit(fanin), F.lit(level - 1))).cast("long")
        at_level = sizes.select(*keys, F.lit(level).alias("level"), n_in.alias("n_in")).filter(F.col("n_in") > 1)
        calls = F.floor(F.col("n_in") / fanin) + F.when(F.col("n_in") % fanin >= 2, 1).otherwise(0)
        levels.append(
            at_level.select(*keys, "level", "n_in", calls.cast("long").alias("calls"),
                            F.ceil(F.col("n_in") / fanin).cast("long").alias("n_out"))
        )
    if not levels:
        return sizes.limit(0).select(*keys, F.lit(1).alias("level"), "n_in", F.col("n_in").alias("calls"), F.col("n_in").alias("n_out"))
    return reduce(DataFrame.unionByName, levels)


def refine_budget(position: int, n: int, max_length: int) -> int:
    progress = 1.0 if n == 1 else position / (n - 1)
    return int(max_length * (0.4 + 0.6 * progress))


def refine(
    chunks: DataFrame,
    key: str,
    index: str,
    text: str,
    step: Callable[[str, str, int], str],
    max_length: int = fixed.SUMMARY_CHARS,
) -> DataFrame:
    """Sequential fold over the chunks of one document: ``step(summary so far, chunk, budget)``.

    A failing step ends the fold with what there is; a failing first step fails the job. The
    chunks of a document come to its task sorted and in batches, so the fold holds a batch
    and one summary, however long the document.
    """
    sizes = chunks.groupBy(key).agg(F.count("*").alias("_n"))
    counted = chunks.select(key, index, text).join(broadcast_measured(checkpoint(sizes), 80), key)
    ordered = counted.select(F.col(key).cast("string"), "_n", index, text).repartition(key).sortWithinPartitions(key, index)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary, position, ended = None, "", 0, False

        def folded() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([summary], pa.string())], [key, "summary"])

        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column(0)[row].as_py()
                if own != now or not position:
                    if position:
                        yield folded()
                    now, summary, position, ended = own, "", 0, False
                if not ended:
                    try:
                        summary = step(summary, batch.column(3)[row].as_py(), refine_budget(position, batch.column(1)[row].as_py(), max_length))
                    except Exception:
                        if not summary:
                            raise
                        ended = True
                position += 1
        if position:
            yield folded()

    return ordered.mapInArrow(fold, f"{key} string, summary string")


def document_summaries(chunks: DataFrame, wanted: DataFrame, ports: ModelPorts, **options) -> DataFrame:
    """(collection, document_id, summary) of the wanted documents; blank ones are kept for the caller's error list."""
    chosen = chunks.join(wanted, ["collection", "document_id"], "left_semi")
    return map_reduce(chosen, ["collection", "document_id"], "chunk_index", "content", ports, **options)


def summary_rows(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk-shaped rows of the summaries, with the metadata of their documents."""
    described = summaries.filter(~is_blank(F.col("summary"))).join(
        documents.select("collection", "document_id", "source", "type", "title"), ["collection", "document_id"]
    )
    return described.select(
        "collection",
        F.concat("document_id", F.lit("-summary")).alias("document_id"),
        "source", "type", "title",
        F.lit(None).cast("string").alias("uri"),
        F.lit("summary").alias("embedding_type"),
        F.lit(0).alias("chunk_index"),
        F.col("summary").alias("content"),
        F.lit(None).cast("string").alias("content_hash"),
    )


def sections(documents: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """(collection, order_key, text): per document the summary, else its chunks joined by newlines."""
    raw = chunks.filter(F.col("embedding_type") != "summary").groupBy("collection", "document_id").agg(
        ordered_lines(F.col("chunk_index"), F.col("content"), "\n").alias("raw")
    )
    ordered = documents.groupBy("collection", "document_id").agg(F.min("position").alias("order_key"))
    return (
        ordered.join(raw, ["collection", "document_id"])
        .join(summaries.select("collection", "document_id", "summary"), ["collection", "document_id"], "left")
        .select("collection", "document_id", "order_key", F.coalesce("summary", "raw").alias("text"))
    )


def overview(
    corpus_sections: DataFrame,
    ports: ModelPorts,
    limit: int = fixed.SECTION_GROUP_CHARS,
    max_length: int = fixed.SUMMARY_CHARS,
    fanin: int = fixed.SUMMARY_FANIN,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(collection, summary): sections packed into groups, then map and tree-reduce over the groups."""
    packed = materialise(pack_sections(corpus_sections, limit))
    return map_reduce(
        packed, ["collection"], "group_no", "text", ports, max_length, fanin, bounded=False, materialise=materialise
    )


def overview_rows(overviews: DataFrame) -> DataFrame:
    return overviews.select(
        "collection",
        F.lit(fixed.OVERVIEW_DOC_ID).alias("document_id"),
        F.lit(fixed.OVERVIEW_SOURCE).alias("source"),
        F.lit(fixed.OVERVIEW_TYPE).alias("type"),
        F.lit(fixed.OVERVIEW_TITLE).alias("title"),
        F.lit(None).cast("string").alias("uri"),
        F.lit("summary").alias("embedding_type"),
        F.lit(0).alias("chunk_index"),
        F.col("summary").alias("content"),
        F.lit(None).cast("string").alias("content_hash"),
    )
