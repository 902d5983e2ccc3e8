"""Tensored MinHash and the exact set links against brute force."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from lorebase.llm import minhash, queries, set_links

SMALL = "/root/testdata/sf0.001"


def _set(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def _roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def _brute(rows, percent=80):
    """(doc_id, n_shingles, component_id, kept), counted over the inverted index of whole shingles."""
    sets, holders, edges = [_set(t) for _, t in rows], defaultdict(list), []
    for i, own in enumerate(sets):
        common = defaultdict(int)
        for x in own:
            for j in holders[x]:
                common[j] += 1
            holders[x].append(i)
        edges += [(i, j) for j, c in common.items() if 100 * c >= percent * (len(own) + len(sets[j]) - c)]
    root, least = _roots(len(rows), edges), {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(root[i]), d == least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)


def _got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


def _planted(seed, groups, copies, words):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(words)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(1 + words // 25)):
                copy[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(copy), "a", 1))
    return rows


@pytest.mark.parametrize("cell_bytes", [set_links.CELL_BYTES, 9_000])
def test_near_duplicates_by_brute_force(spark, odd, cell_bytes):
    docs = odd.union(spark.createDataFrame(_planted(1, 6, 12, 90), odd.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _got(minhash.near_duplicates(docs, cell_bytes=cell_bytes)) == _brute(rows)


def test_query_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert _got(queries.op12_minhash(spark, SMALL)) == _brute(rows)


def test_nothing(spark, nothing):
    assert minhash.near_duplicates(nothing).isEmpty()


@pytest.mark.parametrize("hubs", [0, 1, 16])
def test_links_in_a_cell(hubs):
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randrange(2, 60)
        base = [rng.sample(range(5000), rng.randrange(5, 60)) for _ in range(rng.randrange(1, 5))]
        sets = [np.empty(0, np.uint64)]
        for _ in range(n - 1):
            own = list(rng.choice(base))
            for _ in range(rng.randrange(max(1, len(own) // 3))):
                own[rng.randrange(len(own))] = rng.randrange(5000)
            sets.append(np.unique(np.array(own, np.uint64)))
        near = [(i, j) for i in range(n) for j in range(i) if len(sets[i]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        found = set_links.linked(sets, 80, hubs=hubs)
        assert _roots(n, found) == _roots(n, near)
        assert len(found) == n - len(set(_roots(n, near)))  # a forest


def test_boilerplate_is_not_compared_by_pairs():
    rng = random.Random(1)
    base = rng.sample(range(10**6), 730)
    seconds = {}
    for n in (500, 4000):
        sets = [np.unique(np.array(base + [10**6 + i * 400 + k for k in range(270)], np.uint64)) for i in range(n)]
        began = time.process_time()
        assert set_links.linked(sets, 80) == []
        seconds[n] = time.process_time() - began
    assert seconds[4000] < 24 * seconds[500] + 1  # eight times the sets; all pairs would be 64 times


def test_table_keys_meet_the_promised_recall():
    rng = np.random.default_rng(5)
    halves = minhash.halves_for(80)
    odd = rng.integers(0, 1 << 63, 2 * halves * minhash.ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    missed = 0
    for _ in range(400):
        every = rng.integers(0, 1 << 63, 900, np.uint64)
        a, b = (minhash.half_keys(np.sort(every[part]), odd, minhash.ROWS) for part in (slice(0, 810), slice(90, 900)))  # 720 of 900: 0.8
        shared = a == b
        missed += not (shared[:halves].any() and shared[halves:].any())
    assert missed == 0
    assert (1 - (1 - 0.8**minhash.ROWS) ** halves) ** 2 >= 1 - minhash.MISS
