"""Near duplicates by the Jaccard similarity of word shingles.

SimHash fingerprints and MinHash bands retrieve candidates, the exact shingle sets verify
them. Two documents link at a similarity of ``SIMILARITY`` or more; a pair at just that
similarity shares none of the ``BANDS`` bands of ``ROWS`` minima with a probability of
about one in a million. Fingerprints at few differing bits alone find few such pairs.

Equal sets are one node. The nodes of a band, or of a component of fingerprints, make a
candidate cluster; clusters that share a node are one. Sets are read again only for
clusters of several nodes, once for each node. Links inside a cluster are found without
comparing all its pairs (:mod:`set_links`). A document's component is that of all links.

Nulls: a null text counts as empty, and all texts without words are one node. A text of
fewer words than a shingle is one shingle. Repeated rows give repeated results. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import measured, step, text_of, written
from lorebase.llm.set_links import CELL_BYTES, verified
from lorebase.llm.simhash import _BYTE_BITS, _LOWER, choose_code, components, near_links

WIDTH, SIMILARITY, MISS, ROWS = 5, 0.8, 1e-6, 4
#: Shingles hashed together.
STRETCH = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def shingle_set(text: str | None, width: int, memory: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = [memory.get(w) for w in words]
    if None in hashes:
        if len(memory) > 500_000:
            memory.clear()
        memory.update((w, xxhash.xxh64_intdigest(w)) for w in set(words))
        hashes = [memory[w] for w in words]
    h = np.array(hashes, np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : i + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def simhash_of(shingles: np.ndarray) -> int:
    if not len(shingles):
        return 0
    places = shingles.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(shingles), bitorder="little").tobytes(), "little")


def band_keys(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A hash for each band of ROWS minima."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(shingles), STRETCH):
        np.minimum(least, (shingles[None, first : first + STRETCH] * odd[:, None]).min(axis=1), out=least)
    keys = np.arange(len(odd) // ROWS, dtype=np.uint64)
    for row in least.reshape(-1, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def _sketches(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, _text, node (a hash of the set), fp, bands of every row."""
    bands = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        odd = np.array([xxhash.xxh64_intdigest(f"row {i}") | 1 for i in range(bands * ROWS)], np.uint64)
        for batch in batches:
            nodes, fps, keys = [], [], [np.empty(0, np.uint64)]
            for text in batch.column(2):
                own = shingle_set(text.as_py(), width, memory)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                fps.append(simhash_of(own))
                keys.append(band_keys(own, odd))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64))),
                ],
                ["doc_id", "_text", "node", "fp", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, _text bigint, node bigint, fp bigint, bands array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for batch in batches:
            for row in range(batch.num_rows):  # a row at a time: sets are as large as texts
                own = shingle_set(batch.column(2)[row].as_py(), width, memory)
                head = [batch.column(i).slice(row, 1) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*head, pa.array([own.tobytes()], pa.binary())], ["cluster", "node", "shingles"])

    return docs.select("cluster", "node", "text").mapInArrow(run, "cluster bigint, node bigint, shingles binary")


def _links(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, cell_bytes: int) -> DataFrame:
    """node, root: the components of all links between nodes."""
    with step():
        prints = written(nodes.select("fp").distinct(), "prints")
        rooted = components(near_links(prints, choose_code(prints.count())))
        grouped = nodes.select("node", "fp").join(rooted, nodes["fp"] == rooted["node"], "left").select(nodes["node"], F.lit(-1).alias("_band"), F.coalesce("root", "fp").alias("_key"))
        banded = nodes.select("node", F.posexplode("bands").alias("_band", "_key"))
        keyed = written(banded.union(grouped), "bands")
        hubs = written(keyed.groupBy("_band", "_key").agg(F.min("node").alias("a"), F.max("node").alias("_last")).filter("a < _last").drop("_last"), "hubs")
        found = keyed.join(measured(hubs, 24), ["_band", "_key"]).filter("a <> node").select("a", F.col("node").alias("b"))
        clusters = written(components(found), "clusters")
        both = clusters.select("node", F.col("root").alias("cluster")).union(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
        wanted = written(both.join(nodes.select("node", "_text"), "node"), "wanted")
        texts = docs.select(F.xxhash64("text").alias("_text"), text_of().alias("text")).join(measured(wanted, 32), "_text")
        sets = written(_sets(texts, width).groupBy("cluster", "node").agg(F.first("shingles").alias("shingles")), "sets")
        return written(components(verified(sets, round(100 * similarity), cell_bytes)), "components", outlasts=True)


def near_sets(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, component_id, component_size of every row."""
    marked = written(_sketches(docs, width, similarity), "sketches")
    nodes = written(
        marked.groupBy("node").agg(F.min("_text").alias("_text"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")),
        "nodes",
    )
    links = measured(_links(docs, nodes, width, similarity, cell_bytes), 16)
    rooted = nodes.select(F.col("node").alias("_node"), "least", "n").join(links, F.col("_node") == F.col("node"), "left")
    rooted = rooted.select("_node", "least", "n", F.coalesce("root", "_node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    by_node = rooted.select(F.col("_node").alias("node"), "root").join(named, "root").select("node", "component_id", "component_size")
    return marked.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id", "component_size")
