"""Exact nearest neighbours from an index of balls.

The rows of a collection gather around about sqrt(n) of its own vectors; what gathers around one
is cut into balls of at most BALL_ROWS rows, each with its mean as centre and the distance to its
farthest row as radius. The index is two tables: the narrow one of centres and radii, one row a
collection, and the vectors, one row a ball.

A question first asks the balls whose far sides are nearest, until these hold n rows; the n-th
distance found there bounds the rest. A ball whose near side, distance to the centre minus
radius, lies beyond that bound cannot hold a better row and is not read. Balls are compared as
points of Euclidean space; for cosine these are the unit vectors, whose squared distance is twice
the cosine distance. An inner product has no such bound, so it has no index.

Few questions ask ball by ball, in slices of bounded size. Many meet the balls in the grid of the
full scan, and a ball is scored only for the questions of a block that it may serve. The
results are those of :func:`knn.nearest`, ties by id included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.operators.knn import _BLOCK, BLOCK_ROWS, _grid, _packer, _scorer, hot_collections
from lorebase.session import broadcast_limit, checkpoint, materialised, scratch_folder

BALL_ROWS = 512
#: Questions that meet a ball at once.
SLICE = 1024
#: Distances are compared after rounding to ten decimals.
ROUNDING = 2e-10
_CENTRES = "collection string, balls array<string>, counts array<int>, radii array<double>, centres array<double>"
_ROWS = "s_collection string, s_ball string, s_ids array<string>, s_width int, s_values array<double>"


def _points(matrix: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean distances order as the metric does."""
    if metric == "l2":
        return matrix
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _bound(limit, metric: str):
    """How far a point may lie from a question whose n-th distance is ``limit``."""
    return np.sqrt((1 if metric == "l2" else 2) * (limit + ROUNDING)) + 1e-9


def _vectors(column: pa.Array, row: int, width: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _gathered(store: DataFrame, metric: str) -> DataFrame:
    """collection, near (the centre's number), id, vector."""
    rows = store.select(F.col("collection").cast("string"), F.col("id").cast("string"), F.col("embedding").cast("array<double>")).filter("embedding IS NOT NULL")
    sizes = checkpoint(rows.groupBy("collection").agg(F.count("*").alias("n"), F.min_by("embedding", F.xxhash64("id")).alias("one")))
    sized = rows.join(sizes.select("collection", "n"), "collection")
    chosen = sized.filter(F.pmod(F.xxhash64("id", F.lit("centre")), F.col("n")) < F.ceil(F.sqrt("n"))).select("collection", "embedding")
    every = chosen.union(sizes.select("collection", "one")).groupBy("collection").agg(F.flatten(F.collect_list("embedding")).alias("c_values"))
    every = checkpoint(every)
    size = every.agg(F.coalesce(F.sum(F.size("c_values") * 8), F.lit(0))).first()[0]
    every = F.broadcast(every) if size <= broadcast_limit(store.sparkSession) else every
    packed = rows.mapInArrow(_packer("s", BLOCK_ROWS), _BLOCK.format(p="s")).join(every, F.col("s_collection") == F.col("collection"))

    def nearest_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column("s_width")[row].as_py()
                own, centres = (_vectors(batch.column(c), row, width) for c in ("s_values", "c_values"))
                near = _apart(_points(own, metric), _points(centres, metric)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("s_collection")[row].as_py()] * len(own), pa.string()), pa.array(near, pa.int32()),
                        batch.column("s_ids")[row].values, pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(own.ravel())),
                    ],
                    ["collection", "near", "id", "vector"],
                )

    return packed.mapInArrow(nearest_centre, "collection string, near int, id string, vector array<double>")


class BallIndex:
    """The two written tables of an index and the metric they serve."""

    def __init__(self, spark: SparkSession, path: str, metric: str) -> None:
        if metric not in ("cosine", "l2"):
            raise ValueError(f"no triangle bound for the metric: {metric}")
        self.spark, self.path, self.metric = spark, path, metric

    @classmethod
    def build(cls, store: DataFrame, metric: str = "cosine", path: str | None = None, ball_rows: int = BALL_ROWS) -> BallIndex:
        """Index of (collection, id, embedding) rows, of one length in each collection; rows without a vector are left out."""
        spark = store.sparkSession
        index = cls(spark, path or scratch_folder(spark, "balls"), metric)

        def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, vectors, number = None, [], [], 0

            def ball() -> pa.RecordBatch:
                matrix = np.array(vectors)
                points = _points(matrix, metric)
                centre = points.mean(axis=0)
                radius = float(_apart(points, centre[None, :]).max())
                return pa.RecordBatch.from_pylist([{
                    "s_collection": key[0], "s_ball": f"{key[1]}-{number}", "s_ids": ids, "s_width": matrix.shape[1], "s_values": matrix.ravel(),
                    "centre": centre, "radius": radius * (1 + 1e-12) + 1e-12,
                }], schema=_BALL)

            for batch in batches:
                for row in range(batch.num_rows):
                    now = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                    if ids and (now != key or len(ids) >= ball_rows):
                        yield ball()
                        ids, vectors, number = [], [], number + 1 if now == key else 0
                    key = now
                    ids.append(batch.column(2)[row].as_py())
                    vectors.append(batch.column(3)[row].values.to_numpy(zero_copy_only=False))
            if ids:
                yield ball()

        dealt = checkpoint(_gathered(store, metric)).repartition("collection", "near").sortWithinPartitions("collection", "near", "id")
        dealt.mapInArrow(balls, f"{_ROWS}, centre array<double>, radius double").write.parquet(f"{index.path}/rows")
        made = spark.read.parquet(f"{index.path}/rows").select("s_collection", "s_ball", F.size("s_ids").alias("n"), "radius", "centre")
        ordered = F.array_sort(F.collect_list(F.struct("s_ball", "n", "radius", "centre")))  # about sqrt(n) balls a collection
        made.groupBy("s_collection").agg(ordered.alias("_b")).select(
            F.col("s_collection").alias("collection"), F.col("_b.s_ball").alias("balls"), F.col("_b.n").alias("counts"), F.col("_b.radius").alias("radii"),
            F.flatten("_b.centre").alias("centres"),
        ).write.parquet(f"{index.path}/centres")
        return index

    def _blocks(self, questions: DataFrame) -> DataFrame:
        """Blocks of questions (collection, query_id, vector, limit); a vector's last value is its limit, infinite for none."""
        bounded = F.concat("vector", F.array(F.coalesce("limit", F.lit(float("inf")))))
        return questions.select(F.col("collection").cast("string"), F.col("query_id").cast("string"), bounded).mapInArrow(_packer("q", SLICE), _BLOCK.format(p="q"))

    def _centres(self) -> DataFrame:
        return self.spark.read.schema(_CENTRES).parquet(f"{self.path}/centres")

    def asked(self, questions: DataFrame, n: int) -> DataFrame:
        """s_collection, s_ball, query_id, vector: the balls that each question (collection, query_id, vector, limit) asks.

        Without a limit, the balls that hold n rows by their far sides; with one, all others
        whose near sides are within it. Questions meet the centres in blocks, not one by one.
        """
        metric = self.metric
        packed = self._blocks(questions).join(self._centres(), F.col("q_collection") == F.col("collection"))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    width = batch.column("q_width")[row].as_py()
                    block = _vectors(batch.column("q_values"), row, width)
                    asked, limits = np.ascontiguousarray(block[:, :-1]), block[:, -1]
                    centres = _vectors(batch.column("centres"), row, width - 1)
                    radii, counts = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("radii", "counts"))
                    away = _apart(_points(asked, metric), centres)
                    wanted = []
                    for question, limit in enumerate(limits):
                        order = np.argsort(away[question] + radii, kind="stable")
                        first = order[: int(np.searchsorted(np.cumsum(counts[order]), n)) + 1]
                        near = first if np.isinf(limit) else np.setdiff1d(np.flatnonzero(away[question] - radii <= _bound(limit, metric)), first)
                        wanted.append(near)
                    times = np.array([len(w) for w in wanted])
                    which = np.repeat(np.arange(len(asked)), times)
                    for start in range(0, len(which), SLICE):
                        part = which[start : start + SLICE]
                        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * (width - 1)), pa.array(asked[part].ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([batch.column("collection")[row].as_py()] * len(part), pa.string()),
                                batch.column("balls")[row].values.take(pa.array(np.concatenate(wanted)[start : start + SLICE])),
                                batch.column("q_ids")[row].values.take(pa.array(part)), vectors,
                            ],
                            schema=_ASKED,
                        )

        return packed.mapInArrow(chosen, "s_collection string, s_ball string, query_id string, vector array<double>")

    def _scored(self, asked: DataFrame, n: int, slices: int) -> DataFrame:
        met = asked.groupBy("s_collection", "s_ball", F.pmod(F.xxhash64("query_id"), F.lit(slices)).alias("_slice")).agg(
            F.collect_list("query_id").alias("q_ids"), F.flatten(F.collect_list("vector")).alias("q_values")
        ).withColumn("q_width", (F.size("q_values") / F.size("q_ids")).cast("int"))
        pairs = self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows").join(met, ["s_collection", "s_ball"])
        return pairs.mapInArrow(_scorer(n, self.metric), "query_id string, collection string, id string, distance double")

    def _met(self, questions: DataFrame, n: int) -> DataFrame:
        """Candidates for questions with limits, from a grid in which blocks of questions meet the balls of their collection.

        What is shuffled are the index and the questions, times the sides of the grid, however
        many balls a question asks. In its cell, a ball is scored for the questions that it may serve.
        """
        metric = self.metric
        rows = self.spark.read.schema(f"{_ROWS}, centre array<double>, radius double").parquet(f"{self.path}/rows")

        def within(columns: dict, row: int, asked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            centre = columns["centre"][row].values.to_numpy(zero_copy_only=False)
            away = _apart(_points(asked, metric), centre[None, :])[:, 0]
            return np.flatnonzero(away - columns["radius"][row].as_py() <= _bound(bounds, metric))

        hot = hot_collections(rows.select(F.col("s_collection").alias("collection")))
        pairs = _grid(rows, materialised(self._blocks(questions)), hot, F.col("s_collection") == F.col("q_collection"))
        return pairs.mapInArrow(_scorer(n, metric, within), "query_id string, collection string, id string, distance double")

    def nearest(self, questions: DataFrame, n: int) -> DataFrame:
        """(query_id, collection, id, distance, rank) as :func:`knn.nearest` gives them.

        Questions that could ask no more pairs of question and ball than the index has rows ask
        ball by ball, and read only these; more of them meet the balls in a grid.
        """
        given = checkpoint(questions.select(
            F.col("collection").cast("string"), F.col("query_id").cast("string"), F.col("embedding").cast("array<double>").alias("vector")
        ).filter("vector IS NOT NULL"))
        slices = max(1, -(-given.count() // SLICE))
        limit = F.lit(None).cast("double").alias("limit")
        near = Window.partitionBy("query_id", "collection").orderBy("distance", "id")
        best = lambda found: found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= n)
        first = checkpoint(best(self._scored(self.asked(given.select("*", limit), n), n, slices)))
        bounded = given.join(self.limits(first, n), ["collection", "query_id"])
        held = self._centres().select("collection", F.size("balls").alias("_balls"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("_rows"))
        most, rows = given.groupBy("collection").agg(F.count("*").alias("_n")).join(held, "collection").agg(
            F.coalesce(F.sum(F.col("_n") * F.col("_balls")), F.lit(0)), F.coalesce(F.sum("_rows"), F.lit(0))
        ).first()
        if most <= rows:
            return best(first.drop("rank").unionByName(self._scored(self.asked(bounded, n), n, slices)))
        whole = first.join(self.limits(first, n).select("collection", "query_id"), ["collection", "query_id"], "left_anti")
        return best(whole.drop("rank").unionByName(self._met(bounded, n)))

    @staticmethod
    def limits(first: DataFrame, n: int) -> DataFrame:
        """The n-th distance of each question; one that found fewer rows has met its whole collection."""
        return first.filter(F.col("rank") == n).select("collection", "query_id", F.col("distance").alias("limit"))


_BALL = pa.schema([
    ("s_collection", pa.string()), ("s_ball", pa.string()), ("s_ids", pa.list_(pa.string())), ("s_width", pa.int32()),
    ("s_values", pa.list_(pa.float64())), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()),
])
_ASKED = pa.schema([("s_collection", pa.string()), ("s_ball", pa.string()), ("query_id", pa.string()), ("vector", pa.list_(pa.float64()))])
