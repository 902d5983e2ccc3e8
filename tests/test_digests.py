"""Digest trees against a plain comparison, and what they leave unread."""

from __future__ import annotations

import hashlib
import random

from lorebase.operators import digests


def _id(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(state):
    return [(c, d, _id(x)) for c, docs in state.items() for d, chunks in docs.items() for x in chunks]


def _tree(spark, state):
    return digests.digest_tree(spark, spark.createDataFrame(_rows(state), "collection string, document_id string, id string"))


def _plain(a, b):
    found = []
    for c in a.keys() | b.keys():
        for d in a.get(c, {}).keys() | b.get(c, {}).keys():
            x, y = a.get(c, {}).get(d), b.get(c, {}).get(d)
            if (set(x) if x else None) != (set(y) if y else None):
                found.append((c, d, "added" if not x else "removed" if not y else "changed"))
    return sorted(found)


def test_differing_documents(spark):
    rng = random.Random(2)
    before = {c: {f"d{i}": [f"{c}{i}-{k}" for k in range(rng.randrange(1, 4))] for i in range(60)} for c in "abcd"}
    after = {c: {d: list(x) for d, x in docs.items()} for c, docs in before.items()}
    after["a"]["d3"].append("more")
    after["a"]["d3"].append("more")  # a repeat of a chunk is one
    after["a"]["d4"] = list(reversed(after["a"]["d4"])) * 2  # order and repeats are no change
    after["b"]["d5"], after["b"]["d6"] = after["b"]["d6"], after["b"]["d5"]  # swapped contents
    del after["c"]["d7"]
    after["e"] = {"d0": ["new"]}
    old, new = _tree(spark, before), _tree(spark, after)
    assert sorted(tuple(r) for r in digests.differing_documents(old, new).collect()) == _plain(before, after)
    assert sorted(r.collection for r in digests.differing_roots(old, new).collect()) == ["a", "b", "c", "e"]
    assert digests.differing_documents(old, old).isEmpty()


def test_only_differing_ranges_are_opened(spark):
    before = {"a": {f"d{i}": [f"t{i}"] for i in range(3000)}}
    after = {"a": {**before["a"], "d17": ["other"]}}
    found = digests.differing_documents(_tree(spark, before), _tree(spark, after))
    assert [tuple(r) for r in found.collect()] == [("a", "d17", "changed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = hashlib.md5(b"d17").hexdigest()[0]
    assert f"first#" in plan and f"= {first})" in plan.replace("IN (", "= ")  # the partition of one first digit


def test_nothing(spark):
    empty = _tree(spark, {})
    assert digests.differing_documents(empty, empty).isEmpty()
    assert [tuple(r) for r in digests.differing_documents(empty, _tree(spark, {"a": {"d": ["x"]}})).collect()] == [("a", "d", "added")]


def test_overview_rule(spark):
    state = {"same": {"d": ["x"]}, "new": {"d": ["y"]}, "kept": {"d": ["z"], "blank": ["b"]}}
    later = {"same": {"d": ["x"]}, "new": {"d": ["y2"]}, "kept": {"d": ["z"]}}
    unlisted = spark.createDataFrame([("kept", "blank")], "collection string, document_id string")
    have = spark.createDataFrame([("same",), ("kept",)], "collection string")
    got = {r.collection: (r.root_differs, r.documents_differ, r.skip) for r in digests.overview_due(_tree(spark, state), _tree(spark, later), unlisted, have).collect()}
    assert got == {"same": (False, 0, True), "new": (True, 1, False), "kept": (True, 0, True)}
