"""SimHash, licence scan, mixing and resharding against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lorebase.llm import licenses, mixing, near_sets, resharding, simhash


def _slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _slow_components(nodes):
    nodes = sorted(nodes)
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark, odd):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(500)]
    more, number = [], 100
    for _ in range(12):
        base = rng.choices(words, k=120)
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed"
            more.append((number, " ".join(copy), "a", 1))
            number += 1
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    prints = [(r["doc_id"], _slow_fingerprint(r["text"])) for r in docs.collect()]
    roots = _slow_components({p for _, p in prints})
    least = defaultdict(list)
    for doc_id, p in prints:
        least[roots[p]].append(doc_id)
    want = Counter((i, f"{p:016x}", min((x for x in least[roots[p]] if x is not None), default=None), len(least[roots[p]])) for i, p in prints)
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id", "component_size").collect())
    assert got == want


def test_no_documents(nothing):
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("blocks", [2, 3])
def test_anchors_cover_and_meet(blocks):
    rng = np.random.default_rng(1)
    for _, width, parity in simhash.CODES[blocks]:
        values = rng.integers(0, 1 << width, 200, dtype=np.uint64)
        owner, _ = simhash.anchors(values, width, parity, 1)
        assert set(owner.tolist()) == set(range(200))  # covering radius 1
        apart = simhash.LIMIT // blocks
        other = values.copy()
        for k in range(apart):
            other ^= np.uint64(1) << rng.integers(0, width, 200, dtype=np.uint64)
        mine, theirs = ([set() for _ in range(200)] for _ in range(2))
        for sets, given in ((mine, values), (theirs, other)):
            for i, a in zip(*(x.tolist() for x in simhash.anchors(given, width, parity, 1 + apart)), strict=True):
                sets[i].add(a)
        assert all(a & b for a, b in zip(mine, theirs, strict=True))


@pytest.mark.parametrize("blocks", [2, 3])
def test_links_of_planted_neighbours(spark, blocks):
    rng = random.Random(blocks)
    nodes = {rng.getrandbits(64) for _ in range(150)}
    hub = rng.getrandbits(64)
    nodes |= {hub ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(20, 40, 2)}  # one anchor with hundreds
    for n in list(nodes)[:60]:
        flips = rng.sample(range(64), rng.randrange(1, 7))
        nodes.add(n ^ sum(1 << f for f in flips))
    signed = [(int(np.uint64(n).astype(np.int64)),) for n in nodes]
    found = simhash.components(simhash.near_links(spark.createDataFrame(signed, "fp bigint"), blocks)).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r["root"]] |= {r["node"] % (1 << 64), r["root"] % (1 << 64)}
    want = defaultdict(set)
    for n, root in _slow_components(nodes).items():
        want[root].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_large_groups_compare_in_matrices():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) for b in range(40)] + [base]))
    a, b = simhash._links(np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int8), fps)
    roots = {int(f): int(f) for f in fps} | dict(zip(b.tolist(), a.tolist(), strict=True))
    assert roots == _slow_components({int(f) for f in fps})


def test_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_code_choice_follows_the_count():
    assert simhash.choose_code(1000) == 3 and simhash.choose_code(10**10) == 2


def test_licences(spark, odd, nothing):
    apache = licenses.NOTICES["Apache-2.0-header"]
    filler = " ".join(f"filler{i}" for i in range(300))
    cut = " ".join(apache.split()[:66])
    rows = [
        (30, f"{filler} {apache} {filler}", "a", 1),
        (31, f"x\n{licenses.NOTICES['MIT']}.\n{filler}", "a", 1),
        (32, f"{filler} {cut}", "a", 1),
        (33, " ".join(apache.split()[:20]), "a", 1),
    ]
    docs = odd.union(spark.createDataFrame(rows, odd.schema))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()}

    def slow(text):
        own = set(licenses.shingles_of(text, {}).tolist())
        for name, notice in licenses.NOTICES.items():
            want = set(licenses.shingles_of(notice, {}).tolist())
            if len(own & want) / len(want) >= licenses.CONTAINMENT:
                yield name

    assert got == {(r["doc_id"], n) for r in docs.collect() for n in slow(r["text"])}
    assert (30, "Apache-2.0-header") in got and (33, "Apache-2.0-header") not in got
    assert licenses.scan_licenses(nothing).collect() == []


def test_long_text_in_stretches(monkeypatch):
    monkeypatch.setattr(licenses, "STRETCH", 64)
    notice = licenses.NOTICES["GPL-notice"]
    scanner = licenses.Scanner(licenses.NOTICES, licenses.CONTAINMENT)
    for lead in range(0, 200, 7):
        text = " ".join(f"f{i}" for i in range(lead)) + " " + notice + " " + " ".join(f"g{i}" for i in range(100))
        assert scanner.scan(text)["GPL-notice"][0] == 1.0


def share_out(budget, caps, weights):
    """Parts of a budget by weight, none above its cap; rounded down.

    The level to which all parts are filled is the largest of (budget - caps of the
    smaller ones) / (weights of the rest), in the order of cap / weight.
    """
    order = sorted(caps, key=lambda k: (Fraction(caps[k], weights[k]), k))
    rest, level, taken = sum(weights.values()), 0.0, 0
    for k in order:
        level = max(level, (budget - taken) / rest)
        taken, rest = taken + caps[k], rest - weights[k]
    return {k: min(caps[k], math.floor(weights[k] * level)) for k in caps}


def leaf_budgets(leaves, budget, weights):
    """Budgets of the leaves; ``leaves`` has what each can use, ``weights`` each level's weights (1 if not named)."""
    depth = len(weights)
    caps: list[dict[tuple, int]] = [defaultdict(int) for _ in range(depth + 1)]
    for leaf, cap in leaves.items():
        for level in range(depth + 1):
            caps[level][leaf[:level]] += cap
    given = {(): min(budget, caps[0][()])}
    for level in range(1, depth + 1):
        children: dict[tuple, dict[str, int]] = defaultdict(dict)
        for node, cap in caps[level].items():
            children[node[:-1]][node[-1]] = cap
        given = {
            (*parent, name): part
            for parent, own in children.items()
            for name, part in share_out(given[parent], own, {k: weights[level - 1].get(k, 1) for k in own}).items()
        }
    return given


def test_shares():
    assert share_out(10, {"a": 100, "b": 100}, {"a": 1, "b": 4}) == {"a": 2, "b": 8}
    assert share_out(10, {"a": 1, "b": 100, "c": 100}, {"a": 2, "b": 1, "c": 2}) == {"a": 1, "b": 3, "c": 6}
    assert share_out(10, {"a": 1, "b": 2}, {"a": 1, "b": 1}) == {"a": 1, "b": 2}
    leaves = {("x", "p"): 10, ("x", "q"): 1000, ("y", "p"): 30}
    # What p lacks goes to q first; y's shortage only then goes to x.
    assert leaf_budgets(leaves, 200, [{}, {}]) == {("x", "p"): 10, ("x", "q"): 160, ("y", "p"): 30}


def test_mix(spark, odd, nothing):
    levels = {"source": F.col("source")}
    docs = odd.union(spark.createDataFrame([(200 + i, "w " * (i % 5 + 1), "d", 1) for i in range(300)], odd.schema))
    got = mixing.mix(docs, levels, [{"d": 3}], 0.5, 2, seed=1)
    taken = got.groupBy("_leaf.source").agg(F.sum("_tokens").alias("n")).collect()
    have = {r["source"] or "": r["n"] for r in docs.select("source", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    budget = leaf_budgets({(k,): 2 * v for k, v in have.items()}, sum(have.values()) // 2, [{"d": 3}])
    for r in taken:
        assert r["n"] <= budget[r["source"],]
    assert got.columns[:4] == docs.columns
    # The prefix is a prefix: no document left out of the last epoch comes before one that is in it.
    places = docs.filter("source = 'd'").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), "doc_id")
    order = [r["doc_id"] for r in places.withColumn("p", mixing.place(1, F.lit(0))).orderBy("p").collect()]
    own = {r["doc_id"] for r in got.filter("_leaf.source = 'd' AND _epoch = 0").collect()}
    assert set(order[: len(own)]) == own or len(own) == len(order)
    assert mixing.mix(nothing, levels, [{}], 0.5, 2).collect() == []


def test_flow_moves_the_least():
    sizes, room = {0: 50, 1: 10, 2: 30}, {0: 30, 1: 30, 2: 30}
    flow = resharding.least_moves(sizes, room)
    assert flow == {(0, 0): 30, (0, 1): 20, (1, 1): 10, (2, 2): 30}
    rng = random.Random(1)
    for _ in range(20):
        old = {i: rng.randrange(100) for i in range(rng.randrange(1, 8))}
        new = resharding.capacities_of(sum(old.values()), rng.randrange(1, 8))
        found = resharding.least_moves(old, new)
        assert sum(v for (i, j), v in found.items() if i != j) == sum(old.values()) - sum(min(old.get(j, 0), new[j]) for j in new)
        for i in old:
            assert sum(v for (a, _), v in found.items() if a == i) == old[i]
        for j in new:
            assert sum(v for (_, b), v in found.items() if b == j) == new[j]


def test_reshard(spark, odd, nothing):
    docs = odd.union(spark.createDataFrame([(500 + i, "y" * (i % 37), "z", 1) for i in range(2000)], odd.schema))
    docs = docs.filter("doc_id IS NULL OR doc_id <> 8")
    folder, placed = resharding.reshard(docs, F.when(F.col("doc_id") < 1500, 0).otherwise(1), 4)
    rows = placed.select("doc_id", "text", "kept", "shard", "slot", resharding.size_of().alias("size")).collect()
    assert Counter((r["doc_id"], r["text"], r["kept"]) for r in rows) == Counter((r["doc_id"], r["text"], r["kept"]) for r in docs.collect())
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in own) for own in by_shard.values()]
    assert len(by_shard) == 4 and max(sizes) - min(sizes) < 0.02 * sum(sizes)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    _, none = resharding.reshard(nothing, F.lit(0), 4)
    assert none.collect() == []


def test_untouched_shards_are_not_rewritten(spark):
    docs = spark.createDataFrame([(i, "t" * 9, "a", 1) for i in range(40)], "doc_id bigint, text string, source string, kept int")
    folder, placed = resharding.reshard(docs, F.pmod("doc_id", F.lit(4)), 4)
    assert placed.count() == 40 and placed.select("shard", "slot").distinct().count() == 40
    assert Counter(r["shard"] for r in placed.collect()) == {0: 10, 1: 10, 2: 10, 3: 10}


def _shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("cell_bytes", [1 << 24, 4000])
def test_near_sets(spark, odd, nothing, cell_bytes):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(900)]
    rows = []
    for base in range(12):
        text = rng.choices(words, k=rng.choice([40, 150, 400]))
        for copy in range(8):
            own = list(text)
            for _ in range(rng.randrange(1 + len(own) // 35)):
                own[rng.randrange(len(own))] = f"changed{rng.random()}"
            rows.append((100 + base * 10 + copy, " ".join(own), "a", 1))
    docs = odd.union(spark.createDataFrame(rows, odd.schema))
    every = [(r["doc_id"], _shingles(r["text"])) for r in docs.collect()]
    root = list(range(len(every)))
    for i, (_, a) in enumerate(every):
        for j, (_, b) in enumerate(every[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    ids = {r: [every[i][0] for i, x in enumerate(root) if x == r] for r in set(root)}
    want = Counter((d, min((x for x in ids[r] if x is not None), default=None), len(ids[r])) for (d, _), r in zip(every, root, strict=True))
    assert Counter(tuple(r) for r in near_sets.near_sets(docs, cell_bytes=cell_bytes).collect()) == want
    assert near_sets.near_sets(nothing).collect() == []


def test_pipeline_drops_copies_at_08_to_095(spark):
    rng = random.Random(4)
    rows, gone = [], set()
    for n in range(12):
        text = [f"p{rng.randrange(5000)}" for _ in range(300)]
        other = list(text)
        for i in range(1 + n // 2):  # each change takes five of the 296 shingles from both sides
            other[10 + i * 40] = f"new{n}"
        a, b = _shingles(" ".join(text)), _shingles(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.97
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(other))]
        gone.add(2 * n + 1)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {d for d, _ in rows} - gone


def test_short_notices(spark):
    rows = [(1, "All rights  reserved."), (2, "some words before: ALL RIGHTS RESERVED, and after"), (3, "all rights are reserved"), (4, "// SPDX-License-Identifier: MIT\nx"), (5, "rights reserved all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in licenses.scan_licenses(docs).collect()}
    assert got == {(1, "All-rights-reserved", 1.0, 0), (2, "All-rights-reserved", 1.0, 3), (4, "SPDX-MIT", 1.0, 0)}
    assert {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs, {"one": "after"}).collect()} == {(2, "one")}
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, {"none": " .,; "})


@pytest.mark.parametrize("cell_bytes", [near_sets.CELL_BYTES, 30_000])
def test_near_sets_find_the_links_of_the_given_documents(spark, cell_bytes):
    """Components at 0.8 of five-word shingles over all documents, by an inverted index: recall and precision are 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, holders, edges = [], defaultdict(list), []
    for i, (_, text) in enumerate(rows):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        common = Counter(j for x in own for j in holders[x])
        edges += [(i, j) for j, c in common.items() if 5 * c >= 4 * (len(own) + len(sets[j]) - c)]
        for x in own:
            holders[x].append(i)
        sets.append(own)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    want = {d: least[find(i)] for i, (d, _) in enumerate(rows) if sets[i]}
    got = {r["doc_id"]: r["component_id"] for r in near_sets.near_sets(docs, cell_bytes=cell_bytes).collect()}
    assert {d: got[d] for d in want} == want
    assert len(edges) > 100


def test_budgets_of_many_leaves(spark):
    rng = random.Random(8)
    rows = [(f"a{rng.randrange(5)}", f"b{i % 4000}", rng.choice([0, 1, 5, 5, 30, 1000])) for i in range(9000)]
    rows = [(x, y, n) for (x, y), n in {(x, y): n for x, y, n in rows}.items()]
    weights = [{"a1": 3, "a2": 7}, {"b5": 2, "b6": 9}]
    total = sum(n for _, _, n in rows)
    for budget in (0, total // 3, total):
        want = leaf_budgets({(x, y): n for x, y, n in rows}, budget, weights)
        got = mixing.leaf_budgets(spark.createDataFrame(rows, "x string, y string, cap bigint"), ["x", "y"], budget, weights)
        assert {(r["x"], r["y"]): r["budget"] for r in got.collect()} == want


def test_mix_with_a_leaf_for_each_of_many_documents(spark):
    n = 120_000  # more leaves than any driver-side limit of before
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit(1).alias("_epoch"), F.lit("x").alias("_leaf"), F.lit(None).cast("int").alias("_tokens"))
    got = mixing.mix(docs, {"source": F.col("doc_id").cast("string")}, [{}], 0.5, 2)
    assert sorted(got.columns) == ["_epoch", "_leaf", "_tokens", "doc_id", "text"]
    assert got.count() == 0  # half of each document's tokens fits no document
    assert mixing.mix(docs, {"source": F.col("doc_id").cast("string")}, [{}], 1.0, 2).agg(F.count("*"), F.countDistinct("doc_id")).first()[:] == (n, n)


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, nothing):
    """Every stage takes nulls, repeats, a very long text and clashing columns, and leaves an empty table empty."""
    clashing = odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(None).cast("int").alias("n_lines"), "kept")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line dedup", "SimHash near-dedup", "mixing"):
        got = stages[name](spark, clashing, "/root/testdata/sf0.001")
        assert got.columns == clashing.columns and 0 < got.count() <= 2 * clashing.count()
        assert stages[name](spark, clashing.limit(0), "/root/testdata/sf0.001").isEmpty()
    assert stages["line dedup"](spark, clashing, "").count() == clashing.count()
    judged = stages["quality rules"](spark, clashing, "/root/testdata/sf0.001")
    assert judged.columns == clashing.columns and judged.count() <= clashing.count()
    assert stages["byte-level BPE"](spark, clashing, "").filter("round_trip").count() == clashing.count()
