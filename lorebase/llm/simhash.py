"""Near duplicates by SimHash fingerprints and anchor points.

Fingerprints link at ``LIMIT`` or fewer differing bits of 64. The bits are cut into
blocks; two linked fingerprints differ in at most LIMIT // blocks bits of some block. In
a block, the anchors are the words of a linear covering code: every value lies within
the covering radius R of an anchor, so two values at most t apart meet at an anchor
within R + t of both. Each fingerprint is replicated to all those anchors, and the
fingerprints of one anchor are compared in full, with all 64 bits.

The code of a block has r parity bits; its parity-check matrix has all non-zero r-bit
columns (some twice), so R = 1. The anchors within a distance are found by the
syndrome: the error patterns of the same syndrome lead to them. :func:`choose_code`
takes the number of blocks by the number of fingerprints: more blocks mean fewer
replicas, fewer blocks mean more anchors and so fewer comparisons. Any choice finds all
links.

Equal fingerprints are one node throughout, so copies cost nothing beyond counting. An
anchor that many fingerprints share is cut into slices, and every pair of slices is
compared in its own task. A task links the fingerprints of an anchor by a spanning
forest, not by all pairs. Components come from alternating star steps on the forest.

Nulls: a null text counts as empty and has fingerprint zero, as has any text without
words. Rows without doc_id have a fingerprint and a component, but never name it, unless
no row of the component has a doc_id. Repeated rows give repeated results. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import discard, hot_slices, measured, written

LIMIT = 4
SHINGLE = 4
SEED = 42
#: Blocks of the 64 bits (first bit, bits) and parity bits of each block's code.
CODES = {3: [(0, 21, 4), (21, 21, 4), (42, 22, 4)], 2: [(0, 32, 5), (32, 32, 5)]}
#: Values compared with each other at once: rows of a comparison matrix times its columns.
MATRIX = 1 << 21

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: a bit is set if it is set in over half of their hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    places = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


@lru_cache(maxsize=8)
def _patterns(width: int, parity: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the parity check; error patterns of up to ``reach`` bits, by syndrome; where each syndrome begins."""
    columns = np.array([i % ((1 << parity) - 1) + 1 for i in range(width)])
    found = sorted(
        (int(np.bitwise_xor.reduce(columns[list(bits)], initial=0)), sum(1 << b for b in bits))
        for n in range(reach + 1)
        for bits in combinations(range(width), n)
    )
    syndromes = np.array([s for s, _ in found])
    return columns, np.array([p for _, p in found], np.uint64), np.searchsorted(syndromes, np.arange((1 << parity) + 1))


def anchors(values: np.ndarray, width: int, parity: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in values, anchor) for every code word within ``reach`` of each value."""
    columns, patterns, begins = _patterns(width, parity, reach)
    syndrome = np.zeros(len(values), np.int64)
    for bit, column in enumerate(columns):
        syndrome ^= np.where((values >> np.uint64(bit)) & np.uint64(1), column, 0)
    counts = (begins[1:] - begins[:-1])[syndrome]
    owner = np.repeat(np.arange(len(values)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, values[owner] ^ patterns[begins[syndrome[owner]] + offset]


def choose_code(count: int) -> int:
    """Blocks with the least estimated work: 1 µs for a replica, 2 ns for a comparison."""

    def work(blocks: int) -> float:
        total = 0.0
        for _, width, parity in CODES[blocks]:
            replicas = len(_patterns(width, parity, 1 + LIMIT // blocks)[1]) / (1 << parity)
            total += 1e-6 * count * replicas + 1e-9 * (count * replicas) ** 2 / 2 ** (width - parity)
        return total

    return min(CODES, key=work)


def replicas(nodes: DataFrame, blocks: int) -> DataFrame:
    """anchor (with its block's number in the lowest bits), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in range(0, len(every), 4096):
                fps = every[part : part + 4096]
                for number, (first, width, parity) in enumerate(CODES[blocks]):
                    values = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    owner, words = anchors(values, width, parity, 1 + LIMIT // blocks)
                    key = (words.astype(np.int64) << 2) | number
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[owner].view(np.int64))], ["anchor", "fp"])

    return nodes.mapInArrow(run, "anchor bigint, fp bigint")


def forest(a: np.ndarray, b: np.ndarray, size: int, roots: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable position of every position 0 .. size-1 over the edges (a, b)."""
    root = np.arange(size) if roots is None else roots
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b, before[a], before[b]):
            np.minimum.at(root, side, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _links(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links within whole groups of rows that are sorted by key. sides: 0, or 1 and 2 for two slices to compare."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    last = np.repeat(ends, ends - begins)
    root, pending, waiting = np.arange(len(keys)), [], 0

    def settle() -> None:
        nonlocal root, pending, waiting
        if pending:
            root = forest(np.concatenate([x for x, _ in pending]), np.concatenate([y for _, y in pending]), len(keys), root)
        pending, waiting = [], 0

    def note(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal waiting
        close = np.bitwise_count(fps[x] ^ fps[y]) <= LIMIT
        close &= (sides[x] == 0) | (sides[x] != sides[y])
        if close.any():
            pending.append((x[close], y[close]))
            waiting += int(close.sum())
            if waiting > MATRIX:
                settle()

    small = (ends - begins) <= 512
    rows = np.flatnonzero(np.repeat(small, ends - begins))
    for step in range(1, 512):
        rows = rows[rows + step < last[rows]]
        if not len(rows):
            break
        note(rows, rows + step)
    for begin, end in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
        height = max(1, MATRIX // (end - begin))
        for top in range(begin, end, height):
            x = np.arange(top, min(top + height, end))
            left = np.arange(top + 1, end)
            close = np.bitwise_count(fps[x][:, None] ^ fps[left][None, :]) <= LIMIT
            i, j = np.nonzero(close)
            i, j = x[i], left[j]
            good = (i < j) & ((sides[i] == 0) | (sides[i] != sides[j]))
            pending.append((i[good], j[good]))
            settle()
    settle()
    child = np.flatnonzero(root != np.arange(len(keys)))
    return fps[root[child]], fps[child]


def near_links(nodes: DataFrame, blocks: int) -> DataFrame:
    """a, b: a forest over the distinct fingerprints ``nodes`` whose components are those of all links."""
    placed = replicas(nodes, blocks)
    hot = F.broadcast(hot_slices(placed, ["anchor"]))
    marked = placed.join(hot, "anchor", "left").withColumn("_n", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int")
    other = F.when(F.col("_n") > 1, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.lit(0)))
    # A cell is a pair of slices; side 0 stands for a slice with itself, where all rows are compared.
    cells = marked.withColumn("_own", own).withColumn("_other", F.explode(other)).select(
        "anchor", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "fp",
        F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2).cast("tinyint").alias("_side"),
    )
    cell = F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.col("anchor")).otherwise(F.xxhash64("anchor", "_i", "_j"))
    dealt = cells.select(cell.alias("_cell"), "_side", "fp")
    count = partitions_for(nodes)
    dealt = dealt.repartition(count, "_cell").sortWithinPartitions("_cell", "_side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _links(keys, sides, fps.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            part = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(part[0]):
                continue
            held.append(part)
            rows += len(part[0])
            if rows < 1 << 18 or held[0][0][0] == part[0][-1]:
                continue
            keys, sides, fps = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield out(keys[:cut], sides[:cut], fps[:cut])
            held, rows = [(keys[cut:], sides[cut:], fps[cut:])], len(keys) - cut
        if held:
            yield out(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def partitions_for(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the edges (a, b), the smallest node it is connected with.

    Large stars (every node's larger neighbours to its smallest) and small stars (the
    rest) alternate until the edges are stars already. A round joins edges with one row
    for each node, which the adaptive skew split handles; nothing is gathered.
    """

    def smallest(sym: DataFrame) -> DataFrame:
        return sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        r = e.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x")).first()
        return r["n"], r["x"]

    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = mark(edges)
    while seen[0]:
        sym = turned(edges)
        large = sym.join(smallest(sym), "u").filter("v > u AND m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e"))
        before, edges = edges, written(small.select("e.*").filter("a <> b").distinct(), "links")
        discard(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, component_size of every row."""
    marked = written(fingerprints(docs), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    links = near_links(nodes.select("fp"), choose_code(nodes.count()))
    found = measured(written(components(links), "components"), 16)
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    by_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "component_size")
    return marked.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )
