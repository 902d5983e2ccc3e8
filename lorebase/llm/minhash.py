"""Near duplicates by MinHash with tensored banding.

A document is the set of its ``WIDTH``-word shingles. Two collections of ``halves`` half keys, each
the minima of ``ROWS`` hash functions, take 2 * halves * ROWS minima for a document; the keys of
its tables are all pairs of a half key of the first and one of the second collection. So
halves * halves tables with 2 * ROWS minima in every key cost about the square root of the
minima that as many independent tables would. Two sets share a table key exactly if they share a
half key in both collections; at the similarity of ``PERCENT`` that fails with a probability of
at most ``MISS``.

That also says which keys need not be formed: half keys that no other set has go first, then
each set forms the pairs of what is left. Sets with a common table key are one candidate
cluster, found by stars around each key's smallest set and their components. Links are then
confirmed on full sets (:mod:`set_links`), and components of the links are the result.

Equal sets are one node throughout, so copies cost nothing beyond counting; keys are grouped with
map-side combining, so a key that very many sets share reaches its task as one row for each task.
A node is a 64-bit hash of its set, a shingle a 64-bit hash of its words.

Nulls: a null text has no words. A text without words has no shingles and is linked with
nothing: its component is itself. Rows without doc_id never name a component, unless none of its
rows has a doc_id. Repeated rows give repeated results. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import measured, text_of, written
from lorebase.llm.near_sets import shingle_set
from lorebase.llm.set_links import CELL_BYTES, verified
from lorebase.llm.simhash import components

WIDTH, PERCENT, MISS, ROWS = 4, 80, 2e-6, 4
#: Shingles hashed together.
STRETCH = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def halves_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Half keys in a collection, so that a pair at ``percent`` shares one in both collections but for ``miss``."""
    each = 1 - math.sqrt(1 - miss)
    return math.ceil(math.log(each) / math.log(1 - (percent / 100) ** rows))


def half_keys(shingles: np.ndarray, odd: np.ndarray, rows: int) -> np.ndarray:
    """The half keys of both collections, one after the other; a half key's place is part of its value."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(shingles), STRETCH):
        np.minimum(least, (shingles[None, first : first + STRETCH] * odd[:, None]).min(axis=1), out=least)
    keys = np.arange(1, len(odd) // rows + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(-1, rows).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, width: int, halves: int, rows: int) -> DataFrame:
    """doc_id, _row, node (null without shingles), n_shingles, keys (2 * halves half keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        odd = np.array([xxhash.xxh64_intdigest(f"half {i}") | 1 for i in range(2 * halves * rows)], np.uint64)
        for batch in batches:
            nodes, counts, keys = [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py(), width, memory)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None)
                counts.append(len(own))
                keys.append(half_keys(own, odd, rows).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "_row", "node", "n_shingles", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row().alias("_row"), "text").mapInArrow(
        run, f"doc_id {kind}, _row bigint, node bigint, n_shingles bigint, keys array<bigint>"
    )


def table_keys(nodes: DataFrame, halves: int) -> DataFrame:
    """key, node: the table keys that pairs of shared half keys form."""
    halved = nodes.select("node", F.posexplode("keys").alias("_at", "half"))
    shared = halved.groupBy("half").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("half")
    shared = measured(written(shared, "half-keys"), 16)
    own = halved.join(shared, "half", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("_at") < halves, F.col("half"))).alias("one"), F.collect_list(F.when(F.col("_at") >= halves, F.col("half"))).alias("two")
    )
    one = own.select("node", F.explode("one").alias("one"), "two")
    return one.select("node", "one", F.explode("two").alias("two")).select(F.xxhash64("one", "two").alias("key"), "node")


def candidate_clusters(nodes: DataFrame, halves: int) -> DataFrame:
    """cluster, node: components of the sets that share table keys."""
    keyed = written(table_keys(nodes, halves), "table-keys")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_last")).filter("a < _last").drop("_last")
    pairs = keyed.join(measured(written(hubs, "table-hubs"), 24), "key").filter("a <> node").select("a", F.col("node").alias("b"))
    rooted = written(components(pairs), "clusters")
    return rooted.select("node", F.col("root").alias("cluster")).union(rooted.select(F.col("root"), F.col("root")).distinct())


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cluster, node, shingles: the full set of every wanted node (cluster, node, _row), from one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            for row in range(batch.num_rows):  # a row at a time: sets are as large as texts
                own = shingle_set(batch.column(2)[row].as_py(), width, memory)
                head = [batch.column(i).slice(row, 1) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*head, pa.array([own.tobytes()], pa.binary())], ["cluster", "node", "shingles"])

    texts = docs.select(_row().alias("_row"), text_of().alias("text")).join(measured(wanted, 32), "_row")
    found = texts.select("cluster", "node", "text").mapInArrow(run, "cluster bigint, node bigint, shingles binary")
    return found.groupBy("cluster", "node").agg(F.first("shingles").alias("shingles"))  # repeated rows


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, component_size, kept of every row."""
    halves = halves_for(percent)
    marked = written(sketches(docs, width, halves, ROWS), "sketches")
    named = marked.filter("node IS NOT NULL").groupBy("node")
    nodes = written(named.agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("_row").alias("_row"), F.first("keys").alias("keys")), "nodes")
    clusters = candidate_clusters(nodes.select("node", "keys"), halves)
    wanted = written(clusters.join(nodes.select("node", "_row"), "node"), "wanted")
    sets = written(sets_of(docs, wanted, width), "sets")
    found = measured(written(components(verified(sets, percent, cell_bytes)).withColumnRenamed("node", "_child"), "components"), 16)
    rooted = nodes.select("node", "least", "n").join(found, F.col("node") == F.col("_child"), "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    # Only nodes with another row, or in a component of several, need a look-up; the others are themselves.
    told = rooted.join(least, "root").filter("component_size > 1").select(F.col("node").alias("_node"), "component_id", "component_size")
    joined = marked.select("doc_id", "n_shingles", "node").join(measured(written(told, "told"), 24), F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("component_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce("component_size", F.lit(1)).alias("component_size"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
