"""Exact links inside clusters of candidate sets, as a forest.

Two sets link if 100 |A n B| >= percent |A u B|. A cluster's components are found without a row
for each pair of its sets, and without comparing what is connected already:

* ``linked`` works on one cell. Its sets are first compared with a few hubs; as long as a hub
  takes sets away, the next one is tried. What a cell's largest component leaves over meets the
  others through a prefix filter: in the order of rising frequency, two sets that link share one
  of the first |A| - ceil(percent |A| / 100) + 1 elements. Elements that one set alone has never
  lead to a comparison, so sets that merely share boilerplate are hardly ever compared.
* A cluster of up to ``cell_bytes`` is one cell. A larger one is compared with ``HUBS`` of its
  sets by Spark, in a broadcast or a join. The rest, all sets outside the largest hub's star, is
  cut into slices, the whole cluster too, and every slice of the rest meets every slice of the
  cluster in a task of its own. One group of near copies of any size so costs one comparison a
  set; only a large cluster without a large star is replicated by the number of rest slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import BROADCAST_BYTES, measured, written
from lorebase.llm.simhash import partitions_for

CELL_BYTES = 16 << 20
HUBS = 4
#: Comparisons of one set at a time.
CHUNK = 256


def links(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether sets of a and b elements, ``common`` of them shared, link; sets without elements never do."""
    return (100 * common >= percent * (a + b - common)) & (common > 0)


class _Labels:
    """Components of positions, and the edges that joined them."""

    def __init__(self, size: int) -> None:
        self.of = np.arange(size)
        self.members = {i: [i] for i in range(size)}
        self.edges: list[tuple[int, int]] = []

    def join(self, x: int, y: int) -> None:
        a, b = int(self.of[x]), int(self.of[y])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.of[moved] = a
        self.members[a] += moved
        self.edges.append((x, y))


def linked(sets: list[np.ndarray], percent: int, hubs: int = 16) -> list[tuple[int, int]]:
    """A forest over the positions of ``sets`` (sorted, without repeats) whose components are those of all links."""
    sizes = np.array([len(s) for s in sets], np.int64)
    known = _Labels(len(sets))
    if len(sets) < 2 or not sizes.sum():
        return []
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    rest = np.flatnonzero(sizes)
    # Hubs, as long as they take sets away.
    left, left_owner = every, owner
    for _ in range(hubs):
        if len(rest) < 2:
            break
        hub, rest = int(rest[0]), rest[1:]
        own = sets[hub]
        at = np.minimum(np.searchsorted(own, left), len(own) - 1)
        common = np.bincount(left_owner[own[at] == left], minlength=len(sets))[rest]
        close = links(common, sizes[rest], len(own), percent)
        for y in rest[close].tolist():
            known.join(hub, y)
        rest = rest[~close]
        if not close.any():
            break
        inside = np.isin(left_owner, rest)
        left, left_owner = left[inside], left_owner[inside]
    # Elements by rising frequency; each set's shared elements within its prefix.
    _, number, frequency = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((number, frequency[number], owner))
    place = np.arange(len(every)) - starts[owner]  # owners are in order before and after sorting
    prefix = sizes - -(-percent * sizes // 100) + 1
    chosen = order[(place < prefix[owner]) & (frequency[number[order]] > 1)]
    element, holder = number[chosen], owner[chosen]
    by = np.lexsort((holder, element))
    posting, bounds = holder[by], np.searchsorted(element[by], np.arange(len(frequency) + 1))
    first_of = np.searchsorted(holder, np.arange(len(sets) + 1))
    largest = max(known.members, key=lambda r: len(known.members[r]))
    outside = np.flatnonzero(known.of != largest)
    number = number.astype(np.int32)
    mark = np.zeros(len(frequency), np.uint8)
    waiting = np.zeros(len(sets), bool)
    waiting[outside] = True
    for x in outside.tolist():
        waiting[x] = False  # sets outside that are still waiting will meet x themselves
        mine = element[first_of[x] : first_of[x + 1]]
        if not len(mine):
            continue
        found = np.unique(np.concatenate([posting[bounds[e] : bounds[e + 1]] for e in mine.tolist()]))
        found = found[~waiting[found] & (100 * sizes[found] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[found])]
        found = found[known.of[found] != known.of[x]]
        mark[number[starts[x] : starts[x + 1]]] = 1
        while len(found):
            now, found = found[:CHUNK], found[CHUNK:]
            inside = mark[np.concatenate([number[starts[y] : starts[y + 1]] for y in now.tolist()])]
            common = np.add.reduceat(inside, np.cumsum(sizes[now]) - sizes[now], dtype=np.int64)
            for y in now[links(common, sizes[now], sizes[x], percent)].tolist():
                known.join(x, y)
            found = found[known.of[found] != known.of[x]]
        mark[number[starts[x] : starts[x + 1]]] = 0
    return known.edges


def _cells(sides: DataFrame, percent: int) -> DataFrame:
    """a, b: links found in cells (_cell, node, shingles)."""
    cells = sides.repartition(partitions_for(sides), "_cell").sortWithinPartitions("_cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, own = None, [], []

        def out() -> pa.RecordBatch:
            found = linked(own, percent)
            a, b = ([nodes[x[side]] for x in found] for side in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in range(batch.num_rows):
                now, node = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if now != key:
                    if len(nodes) > 1:
                        yield out()
                    key, nodes, own = now, [], []
                if not nodes or nodes[-1] != node:  # a set of the rest comes twice where it meets its own slice
                    nodes.append(node)
                    own.append(np.frombuffer(batch.column(2)[row].as_py(), np.uint64))
        if len(nodes) > 1:
            yield out()

    return cells.mapInArrow(run, "a bigint, b bigint")


def _stars(sets: DataFrame, percent: int) -> DataFrame:
    """cluster, a, b: the links of HUBS sets of each cluster with all its sets."""
    hubs = sets.groupBy("cluster").agg(F.sort_array(F.collect_set(F.when(F.col("_hub"), F.col("node")))).alias("_hubs"))
    chosen = sets.join(hubs, "cluster").filter(F.array_contains("_hubs", F.col("node")))
    chosen = written(chosen.select("cluster", F.col("node").alias("a"), F.col("shingles").alias("_own")), "set-hubs")
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("_own")), F.lit(0))).first()[0]
    chosen = F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen
    both = sets.select("cluster", "node", "shingles").join(chosen, "cluster").filter("node <> a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(i)[row].as_py(), np.uint64) for i in (3, 4))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(links(np.array(common), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["cluster", "a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("cluster", "a", F.col("node").alias("b"), "_own", "shingles").mapInArrow(run, "cluster bigint, a bigint, b bigint")


def verified(sets: DataFrame, percent: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """a, b: a forest, up to repeats, of the links inside each cluster of ``sets`` (cluster, node, shingles: sorted 64-bit hashes)."""
    sized = sets.groupBy("cluster").agg(F.sum(F.octet_length("shingles") + 32).alias("_bytes"), F.count("*").alias("_n")).filter("_n > 1")
    sized = written(sized.select("cluster", F.ceil(F.col("_bytes") / cell_bytes).cast("int").alias("_slices"), "_n"), "set-clusters")
    small = sets.join(measured(sized.filter("_slices = 1").select("cluster"), 8), "cluster", "left_semi")
    found = _cells(small.select(F.col("cluster").alias("_cell"), "node", "shingles"), percent)
    if sized.filter("_slices > 1").isEmpty():
        return found
    wide = sets.join(measured(sized.filter("_slices > 1"), 24), "cluster")
    # The hubs are HUBS sets at most, picked by a cut through the hashes of the nodes.
    rank = F.pmod(F.xxhash64("node", F.lit("hub")), F.lit(1 << 40)) * F.col("_n") < F.lit(HUBS << 40)
    wide = written(wide.withColumn("_hub", rank), "set-wide")
    stars = written(_stars(wide, percent), "set-stars")
    best = stars.groupBy("cluster", "a").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "a")).alias("_best"))
    inside = measured(stars.join(best, "cluster").filter("a = _best.a").select("cluster", F.col("b").alias("node"), F.lit(True).alias("_in")), 24)
    told = wide.join(inside, ["cluster", "node"], "left")
    rest = told.withColumn("_rest", F.col("_in").isNull())
    counts = rest.groupBy("cluster").agg(F.sum(F.when(F.col("_rest"), F.octet_length("shingles") + 32).otherwise(0)).alias("_rb"))
    counts = measured(counts.filter("_rb > 0").select("cluster", F.ceil(F.col("_rb") / cell_bytes).cast("int").alias("_parts")), 16)
    dealt = rest.join(counts, "cluster")
    column = F.pmod(F.xxhash64("node"), F.col("_slices")).cast("int")
    part = F.pmod(F.xxhash64(F.lit("rest"), "node"), F.col("_parts")).cast("int")
    cell = lambda r, c: F.xxhash64("cluster", r, c).alias("_cell")
    across = dealt.select("cluster", "node", "shingles", column.alias("_c"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_r"))
    down = dealt.filter("_rest").select("cluster", "node", "shingles", part.alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_c"))
    both = across.union(down.select(*across.columns)).select(cell("_r", "_c"), "node", "shingles")
    return found.union(stars.select("a", "b")).union(_cells(both, percent))
