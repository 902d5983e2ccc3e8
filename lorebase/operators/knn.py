"""Exact top-n nearest vectors per question and collection.

Rows are packed into blocks of vectors in the scan's own tasks, without a shuffle.
Blocks of questions meet blocks of stored vectors on the collection; one matrix
product scores a tile of a pair, in single precision and with a margin; what it finds within a
question's n-th distance so far is measured exactly, and only the running best n of each
question leave the task. The packed questions are written and their bytes counted: up to the session's
limit they are broadcast. Beyond it both block tables are shuffled, and a collection
that holds more than a task's share of the stored rows is dealt to a grid of cells, its
stored blocks to the rows and its question blocks to the columns. Scores are never laid out as one
row per pair, and no candidate is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import broadcast_limit, checkpoint, materialised

BLOCK_ROWS = 4096  # what travels as one row: a pair of blocks costs their sum to move and their product to score
TILE_ROWS = 1024  # what is scored at once
GROUP = 8  # columns of a tile that are one when a first bound is sought
MEASURED_PAIRS = 65_536  # pairs measured exactly before the best are sorted
BLOCK_BYTES = 4 << 20  # wide vectors make shorter blocks
WAITING_ROWS = 65_536  # vectors that a packing task holds back to fill its blocks
HELD_QUESTIONS = 100_000
DECIMALS = 10  # distances are compared at this precision, so that ties fall to the id

_BLOCK = "{p}_collection string, {p}_ids array<string>, {p}_width int, {p}_values array<double>"


def _packer(prefix: str, block_rows: int):
    schema = pa.schema([
        (f"{prefix}_collection", pa.string()),
        (f"{prefix}_ids", pa.list_(pa.string())),
        (f"{prefix}_width", pa.int32()),
        (f"{prefix}_values", pa.list_(pa.float64())),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(collection: str, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([collection], pa.string()),
                    pa.array([ids.tolist()], pa.list_(pa.string())),
                    pa.array([matrix.shape[1]], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, matrix.size], pa.int32()), pa.array(matrix.ravel())),
                ],
                schema=schema,
            )

        def remaining(waiting: dict) -> Iterator[pa.RecordBatch]:
            for name, held in waiting.items():
                if held:
                    yield block(name, np.concatenate([i for i, _ in held]), np.vstack([m for _, m in held]))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=object)
            ids = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=object)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if flat.size % batch.num_rows:
                raise ValueError("vectors of one table differ in dimension")
            matrix = flat.reshape(batch.num_rows, -1)
            size = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, matrix.shape[1]))))
            for name in set(names):
                here = names == name
                held = waiting.setdefault(name, [])
                held.append((ids[here], matrix[here]))
                if sum(len(i) for i, _ in held) >= size:
                    all_ids = np.concatenate([i for i, _ in held])
                    vectors = np.vstack([m for _, m in held])
                    full = len(all_ids) // size * size
                    for start in range(0, full, size):
                        yield block(name, all_ids[start : start + size], vectors[start : start + size])
                    waiting[name] = [(all_ids[full:], vectors[full:])] if full < len(all_ids) else []
            if sum(len(i) for held in waiting.values() for i, _ in held) >= WAITING_ROWS:
                yield from remaining(waiting)
                waiting.clear()
        yield from remaining(waiting)

    return pack


def distance_matrix(questions: np.ndarray, stored: np.ndarray, metric: str) -> np.ndarray:
    """cosine = 1 - cos, l2 = squared Euclidean distance, ip = 1 - dot product."""
    dots = questions @ stored.T
    if metric == "ip":
        distances = 1.0 - dots
    else:
        q2 = np.einsum("ij,ij->i", questions, questions)[:, None]
        s2 = np.einsum("ij,ij->i", stored, stored)[None, :]
        if metric == "l2":
            distances = np.maximum(q2 + s2 - 2.0 * dots, 0.0)
        elif metric == "cosine":
            norms = np.sqrt(q2) * np.sqrt(s2)
            distances = 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        else:
            raise ValueError(f"unknown metric: {metric}")
    return np.round(distances, DECIMALS) + 0.0


def _sizes(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distances of :func:`distance_matrix` between the rows of two tables, row by row."""
    dots = np.einsum("ij,ij->i", a, b)
    if metric == "ip":
        distances = 1.0 - dots
    elif metric == "l2":
        distances = np.maximum(np.einsum("ij,ij->i", a, a) + np.einsum("ij,ij->i", b, b) - 2.0 * dots, 0.0)
    else:
        norms = _sizes(a) * _sizes(b)
        distances = 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    return np.round(distances, DECIMALS) + 0.0


class _Products:
    """Products of two tables in single precision, as bounds of their distances.

    Every metric's distance is within ``worst`` only if a product reaches ``least(worst)``, which holds
    a margin above the rounding error. Values that single precision cannot hold use double.
    """

    def __init__(self, asked: np.ndarray, stored: np.ndarray, metric: str) -> None:
        self.metric = metric
        with np.errstate(all="ignore"):
            self.square = largest = np.zeros(len(asked))
            if metric == "cosine":
                q, s = (np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m, n in ((m, _sizes(m)[:, None]) for m in (asked, stored)))
                self.scale = np.ones(len(q))
            elif metric == "ip":
                q, s = asked, stored
                self.scale = _sizes(q) * _sizes(s).max()
            else:  # |q|2 + |s|2 - 2 q.s <= worst, as a bound of q.s - |s|2 / 2
                half = np.einsum("ij,ij->i", stored, stored) / 2
                q, s = np.hstack([asked, np.ones((len(asked), 1))]), np.hstack([stored, -half[:, None]])
                self.square = largest = np.einsum("ij,ij->i", asked, asked)
                self.scale = _sizes(asked) * _sizes(stored).max() + half.max()
            single = max(np.abs(q).max(), np.abs(s).max(), self.scale.max(), largest.max()) < 1e30
            self.kind = np.float32 if single else np.float64
            self.error = (asked.shape[1] + 8) * 2 * np.finfo(self.kind).eps
            self.q, self.s = q.astype(self.kind), s.astype(self.kind)

    def _below(self, product: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        return product - self.error * (self.scale[rows] + 2 * np.abs(product)) - 1e-9

    def least(self, worst: np.ndarray, rows: slice) -> np.ndarray:
        """A bound of the products of what lies within ``worst``; below all where that is infinite."""
        known = np.where(np.isinf(worst), 0.0, worst)
        product = (self.square[rows] - known) / 2 if self.metric == "l2" else 1.0 - known
        return np.where(np.isinf(worst), -np.inf, self._below(product, rows))

    def least_of_best(self, products: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """A bound of each question's n best, from its products: n groups of columns have a product that reaches it."""
        groups = products.shape[1] // GROUP
        tops = products[:, : groups * GROUP].reshape(len(products), GROUP, groups).max(axis=1) if groups >= n else products
        if tops.shape[1] < n:
            return np.full(len(products), -np.inf)
        best = np.partition(tops, tops.shape[1] - n, axis=1)[:, tops.shape[1] - n].astype(np.float64)
        return self._below(self._below(best, rows), rows)


def _true(flags: np.ndarray, size: int) -> np.ndarray:
    """Places of the few true ones among the first ``size`` flags, looked for eight at a time; the array is eight longer."""
    flags[size : size + 8] = False
    eights = np.flatnonzero(flags[: -(-size // 8) * 8].view(np.uint64))
    places = (eights[:, None] * 8 + np.arange(8)).ravel()
    return places[flags[places]]


class _Best:
    """The best n rows found for each question of a block; ``worst`` is what a further row must not exceed."""

    def __init__(self, query_ids: pa.Array, n: int, worst: np.ndarray) -> None:
        self.query_ids, self.n, self.worst = query_ids, n, worst
        self.ids = np.full((len(query_ids), n), None, dtype=object)
        self.distances = np.full((len(query_ids), n), np.inf)
        self.filled = np.zeros((len(query_ids), n), dtype=bool)

    def meet(self, asked: np.ndarray, stored: np.ndarray, ids: pa.Array, metric: str, which: np.ndarray) -> None:
        """Take in a stored block for the questions ``which``; everything as near as the n-th stays in, so that ties are settled by id."""
        products = _Products(asked, stored, metric)
        sound, sound_s = np.isfinite(asked).all(axis=1) & np.isfinite(products.scale), np.isfinite(stored).all(axis=1)
        room, near = np.empty(TILE_ROWS * TILE_ROWS, products.kind), np.empty(TILE_ROWS * TILE_ROWS + 8, dtype=bool)
        for q in range(0, len(which), TILE_ROWS):
            part = slice(q, min(q + TILE_ROWS, len(which)))
            least = products.least(self.worst[which[part]], part)
            held, pairs = [], 0
            for s in range(0, len(stored), TILE_ROWS):
                tile = slice(s, min(s + TILE_ROWS, len(stored)))
                shape = part.stop - q, tile.stop - s
                if not (sound[part].all() and sound_s[tile].all()):  # no product to trust
                    self._take(which, q, *self._measured(asked[part], stored[tile], metric, self.worst[which[part]], s), ids)
                    continue
                found = np.matmul(products.q[part], products.s[tile].T, out=room[: shape[0] * shape[1]].reshape(shape))
                unknown = np.flatnonzero(np.isneginf(least))
                if len(unknown):
                    least[unknown] = products.least_of_best(found[unknown], q + unknown, self.n)
                np.greater_equal(found, least.astype(products.kind)[:, None], out=near[: found.size].reshape(shape))
                rows, columns = np.divmod(_true(near, found.size), shape[1])
                for at in range(0, len(rows), MEASURED_PAIRS):
                    r, c = rows[at : at + MEASURED_PAIRS], s + columns[at : at + MEASURED_PAIRS]
                    held.append((r, c, pair_distances(asked[q + r], stored[c], metric)))
                    pairs += len(r)
                    if pairs >= MEASURED_PAIRS:
                        self._take(which, q, *map(np.concatenate, zip(*held)), ids)
                        held, pairs = [], 0
            if held:
                self._take(which, q, *map(np.concatenate, zip(*held)), ids)

    def _measured(self, asked: np.ndarray, stored: np.ndarray, metric: str, worst: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            distances = distance_matrix(asked, stored, metric)
        if distances.shape[1] > self.n:
            worst = np.fmin(worst, np.partition(distances, self.n - 1, axis=1)[:, self.n - 1])
        rows, columns = np.nonzero(distances <= worst[:, None])
        return rows, start + columns, distances[rows, columns]

    def _take(self, which: np.ndarray, start: int, rows: np.ndarray, columns: np.ndarray, found: np.ndarray, ids: pa.Array) -> None:
        """Merge measured pairs (question ``which[start + row]``, stored column) into the best; strings are compared only where the n-th place is tied."""
        rows = which[start + rows]
        near = found <= self.worst[rows]
        if not near.any():
            return
        rows, columns, found = rows[near], columns[near], found[near]
        touched = np.unique(rows)
        old, place = np.nonzero(self.filled[touched])
        old = touched[old]
        rows = np.concatenate([old, rows])
        found = np.concatenate([self.distances[old, place], found])
        names = np.concatenate([self.ids[old, place], ids.take(pa.array(columns)).to_numpy(zero_copy_only=False).astype(object)])
        order = np.lexsort((found, rows))
        rows, found, names = rows[order], found[order], names[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        counts = np.diff(np.append(starts, len(rows)))
        full = counts > self.n
        nth = starts[full] + self.n - 1
        last = np.full(len(starts), np.nan)
        last[full] = np.where(found[nth] == found[nth + 1], found[nth], np.nan)
        tied = np.flatnonzero(found == np.repeat(last, counts))
        if len(tied):
            names[tied] = names[tied[np.lexsort((names[tied].astype(str), rows[tied]))]]
        at = np.arange(len(rows)) - np.repeat(starts, counts)
        kept = at < self.n
        self.filled[touched], self.distances[touched], self.ids[touched] = False, np.inf, None
        rows, at = rows[kept], at[kept]
        self.filled[rows, at], self.distances[rows, at], self.ids[rows, at] = True, found[kept], names[kept]
        last = self.distances[touched, self.n - 1]
        self.worst[touched] = np.where(self.filled[touched, self.n - 1], np.minimum(self.worst[touched], last), self.worst[touched])


def _scorer(n: int, metric: str, within=None):
    """Best n rows of every question from pairs of blocks.

    A question's n-th distance so far bounds what its next blocks may add, also after its
    rows have been handed out. With ``within``, the last value of a question's vector is a bound
    known beforehand, and ``within(batch, row, questions, bounds)`` tells which questions a
    stored block can serve at all.
    """
    schema = pa.schema([
        ("query_id", pa.string()), ("collection", pa.string()), ("id", pa.string()), ("distance", pa.float64()),
    ])

    def rows(held: dict[tuple[str, bytes], _Best]) -> Iterator[pa.RecordBatch]:
        for (collection, _), best in held.items():
            at, place = np.nonzero(best.filled)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        best.query_ids.take(pa.array(at)), pa.array([collection] * len(at), pa.string()),
                        pa.array(best.ids[at, place].tolist(), pa.string()), pa.array(best.distances[at, place]),
                    ],
                    schema=schema,
                )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[tuple[str, bytes], np.ndarray] = {}  # eight bytes a question, kept
        held: dict[tuple[str, bytes], _Best] = {}
        questions = 0
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for r in range(batch.num_rows):
                width, q_width = columns["s_width"][r].as_py(), columns["q_width"][r].as_py()
                if q_width - (within is not None) != width:
                    raise ValueError("questions and stored vectors differ in dimension")
                collection = columns["s_collection"][r].as_py()
                stored = columns["s_values"][r].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                asked = columns["q_values"][r].values.to_numpy(zero_copy_only=False).reshape(-1, q_width)
                query_ids = columns["q_ids"][r].values
                key = collection, hashlib.md5("\0".join(map(str, query_ids.to_pylist())).encode()).digest()
                if key not in bounds:
                    bounds[key] = np.full(len(asked), np.inf) if within is None else asked[:, -1].copy()
                which = np.arange(len(asked))
                if within is not None:
                    asked = asked[:, :-1]
                    which = within(columns, r, asked, bounds[key])
                if not len(which) or not len(stored):
                    continue
                if key not in held:
                    held[key] = _Best(pa.array(query_ids.to_pylist(), pa.string()), n, bounds[key])
                    questions += len(query_ids)
                held[key].meet(asked[which], stored, columns["s_ids"][r].values, metric, which)
                if questions >= HELD_QUESTIONS:
                    yield from rows(held)
                    held, questions = {}, 0
        yield from rows(held)

    return score


def hot_collections(store: DataFrame, size: Column | None = None) -> DataFrame:
    """(collection, cells): collections of more than a task's share of all rows, with the side of their grid.

    ``size`` says how many rows a row of the table stands for, if not one.

    With P shuffle partitions there are at most P of them, so the table may be broadcast.
    """
    tasks = int(store.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpoint(store.groupBy(F.col("collection").cast("string").alias("collection")).agg(F.sum(F.lit(1) if size is None else size).alias("n")))
    share = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / tasks
    return counts.filter(F.col("n") > share).select("collection", F.ceil(F.sqrt(F.col("n") / share)).cast("int").alias("cells"))


def _grid(store: DataFrame, questions: DataFrame, hot: DataFrame, same: Column) -> DataFrame:
    """Pairs of blocks; every pair of a hot collection meets in exactly one cell of its grid."""
    def dealt(blocks: DataFrame, side: str, own: str, other: str) -> DataFrame:
        few = F.broadcast(hot.withColumnsRenamed({"collection": f"{side}_collection", "cells": "_cells"}))
        cells = F.coalesce("_cells", F.lit(1))
        ranged = blocks.join(few, f"{side}_collection", "left").withColumn(
            own, F.pmod(F.xxhash64(f"{side}_ids"), cells).cast("int")
        )
        return ranged.withColumn(other, F.explode(F.sequence(F.lit(0), cells - 1))).drop("_cells")

    left, right = dealt(store, "s", "s_row", "s_column"), dealt(questions, "q", "q_column", "q_row")
    return left.join(right, same & (F.col("s_row") == F.col("q_row")) & (F.col("s_column") == F.col("q_column")))


def nearest(
    store: DataFrame,
    questions: DataFrame,
    n: int,
    metric: str = "cosine",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, collection, id, distance, rank): ascending distance, ties by id, rank from 1.

    ``store`` has (collection, id, embedding), ``questions`` (collection, query_id,
    embedding), one row for every collection a question asks.
    """
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric: {metric}")
    packed_store = store.select(
        F.col("collection").cast("string"), F.col("id").cast("string"), "embedding"
    ).filter(F.col("embedding").isNotNull()).mapInArrow(_packer("s", block_rows), _BLOCK.format(p="s"))
    packed_questions = questions.select(
        F.col("collection").cast("string"), F.col("query_id").cast("string"), "embedding"
    ).filter(F.col("embedding").isNotNull()).mapInArrow(_packer("q", block_rows), _BLOCK.format(p="q"))
    packed_questions = materialised(packed_questions)
    size = packed_questions.agg(F.coalesce(F.sum(F.size("q_values") * 8 + F.size("q_ids") * 64), F.lit(0))).first()[0]
    same = F.col("s_collection") == F.col("q_collection")
    if size <= broadcast_limit(store.sparkSession):
        pairs = packed_store.join(F.broadcast(packed_questions), same)
    else:
        # written, as a rerun of a lost task has to deal the same blocks to the same cells
        packed_store = materialised(packed_store)
        hot = hot_collections(packed_store.withColumnRenamed("s_collection", "collection"), F.size("s_ids"))
        pairs = _grid(packed_store, packed_questions, hot, same)
    candidates = pairs.mapInArrow(
        _scorer(n, metric), "query_id string, collection string, id string, distance double"
    )
    nearest_first = Window.partitionBy("query_id", "collection").orderBy("distance", "id")
    return candidates.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= n)
