"""Whitening and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import queries, resampling, whitening

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, component int, n string"


def _exact(vectors):
    """n, deviations and the covariance of x, from fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    apart = [[Fraction(r[i] * n - s[i], n) for i in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in apart) / n) for j in range(d)] for i in range(d)])
    return n, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], v, np.array([[float(a) for a in r] for r in apart])


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6)) * [5, 3, 3, 1, 0.5, 0.2] + 100
    rows = [(i, [float(c) for c in v], 7, "x") for i, v in enumerate(base)]
    odd = [
        (100, None, 1, "x"), (101, [], 1, "x"), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x"), (103, [float("nan")] * 6, 1, "x"),
        (104, [float("inf")] * 6, 1, "x"), (105, [1.0, 2.0], 1, "x"), (None, [99.0] * 6, 1, None), (3, rows[3][1], 7, "x"),
    ]
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS)).collect()
    kept = [r for r in rows + odd if r[1] and len(r[1]) == 6 and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviations, v, apart = _exact([r[1] for r in kept])
    assert len(got) == 6 * len(kept) and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter(zip([r[0] for r in kept], deviations, strict=True))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    mine = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(6):
        want = apart @ axes[:, k] / math.sqrt(values[k])
        have = np.array([mine[r[0], k + 1]["whitened"] for r in kept])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert mine[0, k + 1]["explained"] == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_flat_directions_have_no_coordinate(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], 0, "") for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert got[0]["identity_error"] < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 0, ""), (2, [2.0, 3.0], 0, "")], VECTORS)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same] == [(None, None, None, 0)] * 4


def test_whole_numbers_of_any_size(spark):
    rows = [(1, [1e30, 1.0], 0, ""), (2, [-1e30, 2.0], 0, ""), (3, [3e15, 4.0], 0, ""), (4, [0.0, 8.0], 0, "")]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[1, 1]["deviation"] is None  # beyond 64 bits
    assert got[1, 1]["identity_error"] < 1e-4
    y = np.array([[2**40, 3], [-(2**41), 1], [5, 7]], np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert whitening._product(y).tolist() == want


def test_whitening_of_nothing(spark):
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.isEmpty()


@pytest.mark.parametrize("d", [1, 2, 3, 20])
@pytest.mark.parametrize("equal", [False, True])
def test_eigenpairs(d, equal):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    spectrum = np.where(np.arange(d) < 3, 4.0, 1.0) if equal else np.exp(-np.arange(d) / 3)
    v = q @ np.diag(spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading_components(v, d)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13 * 4
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * 4
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    diagonal, off, _ = whitening.tridiagonal(v)
    shifts = np.array([-1.0, 0.5, 3.0, 9.0])
    assert whitening.sturm_count(diagonal, off, shifts).tolist() == [(np.linalg.eigvalsh(v) < x).sum() for x in shifts]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _brute(docs, target, n, buckets, percent, least):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in texts for f in _features(x, n)[1]) for texts in ([x for _, x in docs], target))
    a, b = sum(s.values()), sum(t.values())
    gain = lambda i: math.floor(1000 * math.log((t[i] + 1) * (a + buckets) / ((s[i] + 1) * (b + buckets))))
    out = []
    for doc_id, text in docs:
        words, found = _features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(f)) for f in found)
        out.append((doc_id, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {}
    for i, r in enumerate(able[: len(able) * percent // 100]):
        rank.setdefault(r, []).append(i + 1)
    return sorted((*r, rank[r].pop(0) if rank.get(r) else None) for r in out) if all(r[0] is not None for r in out) else [(*r, rank[r].pop(0) if rank.get(r) else None) for r in out]


COLUMNS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_by_brute_force(spark, odd, n):
    target = spark.createDataFrame([("three four FIVE\nsix seven", 1), (None, 2), ("old river bank\n\n\ntoday", 3)], "text string, weight int")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = resampling.resample(odd, target, n=n, buckets=97, percent=60, least_words=6)
    want = _brute(docs, [r["text"] for r in target.collect()], n, 97, 60, 6)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == Counter(want)


def test_resampling_query_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = queries.op13_resampling(spark, SMALL).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == _brute(docs, target, 1, 10_000, 10, 20)


def test_resampling_of_nothing(spark, odd, nothing):
    assert resampling.resample(nothing, odd).isEmpty()
    got = resampling.resample(odd, nothing)
    assert got.count() == odd.count() and got.columns == COLUMNS


def test_a_line_that_most_rows_have(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words in every row\n"), F.when(F.col("id") % 3 == 0, F.lit("more")).otherwise(F.lit("")), F.lit("\n")).alias("text"))
    target = docs.limit(1).select("text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = resampling.resample(docs, target, least_words=3, percent=50).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted(_brute(rows, [r["text"] for r in target.collect()], 1, 10_000, 50, 3), key=str)
