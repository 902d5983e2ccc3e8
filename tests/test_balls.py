"""The ball index against the full scan, and what it leaves unread."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.operators import knn
from lorebase.operators.balls import BallIndex
from lorebase.operators.knn import nearest
from lorebase.sources.store import ROW, KnowledgeStore


def _frame(spark, matrix, collections, name):
    rows = [(collections[i], f"v{i:05d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"collection string, {name} string, embedding array<float>")


def _clusters(n, seed, width=8, groups=30):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(0, groups, n)] * 10 + rng.normal(size=(n, width)) * 0.1


def _rows(df):
    return sorted((r["query_id"], r["collection"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equals_the_full_scan(spark, metric):
    matrix = np.vstack([_clusters(400, 1), np.zeros((3, 8)), np.repeat(_clusters(5, 2), 8, axis=0)])  # zero vectors, and ties by id
    names = ["a" if i % 3 else "b" for i in range(len(matrix) - 4)] + ["tiny"] * 4
    store = _frame(spark, matrix, names, "id")
    asked = _frame(spark, np.vstack([matrix[::7], np.zeros((1, 8)), _clusters(20, 3)]), ["a"] * 40 + ["b"] * 30 + ["tiny", "none"] * 10 + ["a"] * 50, "query_id")
    index = BallIndex.build(store, metric, ball_rows=16)
    assert _rows(index.nearest(asked, 6)) == _rows(nearest(store, asked, 6, metric))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_far_balls_are_not_asked(spark, metric):
    matrix = _clusters(3000, 5)
    store = _frame(spark, matrix, ["a"] * 3000, "id")
    index = BallIndex.build(store, metric, ball_rows=32)
    asked = _frame(spark, matrix[:60], ["a"] * 60, "query_id")
    given = asked.select("collection", "query_id", F.col("embedding").cast("array<double>").alias("vector"))
    found = index.nearest(asked, 5)
    assert found.count() == 300
    first = index.asked(given.select("*", F.lit(None).cast("double").alias("limit")), 5).count()
    limits = BallIndex.limits(found, 5)
    again = index.asked(given.join(limits, ["collection", "query_id"]), 5).count()
    balls = spark.read.parquet(f"{index.path}/rows").count()
    assert balls > 80 and first + again < 60 * balls / 4


def test_many_questions_move_no_row_for_every_ball_asked(spark, monkeypatch):
    """All rows ask all rows, and no bound helps: the second round must not ship a vector a question and ball."""
    matrix = np.random.default_rng(7).normal(size=(1200, 8))
    store, asked = (_frame(spark, matrix, ["a"] * 1200, name) for name in ("id", "query_id"))
    index = BallIndex.build(store, "l2", ball_rows=16)
    rounds, plain = [], BallIndex.asked
    monkeypatch.setattr(BallIndex, "asked", lambda self, questions, n: rounds.append(plain(self, questions, n)) or rounds[-1])
    assert _rows(index.nearest(asked, 5)) == _rows(nearest(store, asked, 5, "l2"))
    assert sum(r.count() for r in rounds) < 10 * 1200


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_bounds_keep_what_is_near(spark, metric):
    """Blocks met under a bound, in tiles and after a hand-out, against one exact matrix."""
    rng = np.random.default_rng(11)
    stored = np.vstack([rng.normal(size=(2500, 5)) * 10.0 ** rng.integers(-3, 9, (2500, 1)), np.zeros((2, 5)), np.full((1, 5), np.nan), np.ones((40, 5))])
    asked = np.vstack([rng.normal(size=(1100, 5)), np.zeros((1, 5)), np.ones((2, 5))])
    best = knn._Best(pa.array([str(i) for i in range(len(asked))]), 6, np.full(len(asked), np.inf))
    names = [f"{i:05d}" for i in range(len(stored))]
    for start in range(0, len(stored), 700):
        best.meet(asked, stored[start : start + 700], pa.array(names[start : start + 700]), metric, np.arange(len(asked)))
    exact = knn.distance_matrix(asked, np.delete(stored, 2502, axis=0), metric)
    want = np.sort(exact, axis=1)[:, :6]
    assert np.allclose(best.distances, want, rtol=1e-9, atol=2e-10)
    assert best.ids[-1].tolist()[:6] == names[2503:2509] or metric == "ip" or metric == "cosine"


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_scorer_starts_and_ties_without_a_double_matrix(monkeypatch, metric):
    """Nothing is known of any question at first; copies, some around the n-th place, are settled by id."""
    rng = np.random.default_rng(13)
    stored = rng.integers(0, 4, (3000, 16)).astype(float)
    stored[500:2900:3] = stored[rng.integers(0, 40, 800)]
    asked = np.vstack([stored[:1500], rng.integers(0, 4, (40, 16))]).astype(float)
    names = np.array([f"{i:05d}" for i in rng.permutation(len(stored))])
    exact = np.vstack([knn.pair_distances(np.repeat(a[None, :], len(stored), axis=0), stored, metric) for a in asked])
    monkeypatch.setattr(knn, "distance_matrix", None)
    monkeypatch.setattr(knn, "MEASURED_PAIRS", 5000, raising=False)
    best = knn._Best(pa.array([str(i) for i in range(len(asked))]), 6, np.full(len(asked), np.inf))
    for start in range(0, len(stored), 1300):
        best.meet(asked, stored[start : start + 1300], pa.array(names[start : start + 1300]), metric, np.arange(len(asked)))
    for row in range(len(asked)):
        order = np.lexsort((names, exact[row]))[:6]
        assert sorted(zip(best.distances[row], best.ids[row])) == list(zip(exact[row][order], names[order]))


def test_inner_products_have_no_bound(spark):
    with pytest.raises(ValueError):
        BallIndex.build(_frame(spark, np.eye(2), ["a", "a"], "id"), "ip")


def test_nothing(spark):
    empty = _frame(spark, np.zeros((0, 2)), [], "id")
    index = BallIndex.build(empty)
    assert index.nearest(_frame(spark, np.eye(2), ["a", "a"], "query_id"), 3).isEmpty()


def test_store_answers_through_its_index(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "s"), metric="l2")
    rows = [("a", f"i{i}", f"text {i}", (f"d{i}", "s", "knowledge", "t", "chunk", 0, None), [float(i), 1.0]) for i in range(50)]
    store.upsert(spark.createDataFrame(rows, ROW))
    asked = spark.createDataFrame([("a", "q", [7.2, 1.0])], "collection string, query_id string, embedding array<float>")
    plain = sorted((r.rank, r.id, r.document) for r in store.query(asked, 3).collect())
    version = store.build_index()
    assert version == store.version() and sorted((r.rank, r.id, r.document) for r in store.query(asked, 3).collect()) == plain
    store.upsert(spark.createDataFrame([("a", "new", "nearest", ("x", "s", "k", "t", "chunk", 0, None), [7.2, 1.0])], ROW))
    assert store.query(asked, 1).first().document == "nearest"  # a later version has no index yet
