"""Exact dedup, quality rules and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from lorebase.llm import exact_dedup, line_dedup, quality
from lorebase.llm.common import hot_slices

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def _words(text):
    return [w for w in BLANK.split(text or "") if w]


def _exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[BLANK.sub(" ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        head = True
        for i in ids:
            kept = i == keep and head
            head = head and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("parts", [2, 16])
def test_exact_groups(spark, odd, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        more = [(100 + i, "copied text " * 5, "a", 1) for i in range(400)]
        both = odd.union(spark.createDataFrame(more, odd.schema))
        got = Counter(tuple(r) for r in exact_dedup.exact_groups(both).collect())
        assert got == _exact([*map(tuple, odd.collect()), *more])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_text_is_sliced(spark):
    df = spark.range(1000).selectExpr("if(id < 400, 0, id) AS k")
    assert {r["k"] for r in hot_slices(df, ["k"]).collect()} == {0}


def test_exact_range_shuffle_is_the_only_one_of_texts(spark, odd):
    plan = exact_dedup.exact_groups(odd)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_text" not in plan and "BatchEvalPython" not in plan and "MapInArrow" not in plan


def test_exact_empty(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == []


def _base(text):
    words = _words(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if _words(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def _labels(spark, good=(1, 9)):
    return spark.createDataFrame([(i, 1, 0) for i in good] + [(None, 1, 0), (10, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_base_counts(spark, odd):
    texts = ["a b c d e f g h a b c d e f g h", "x " * 40, "a b c d e f g h i a b c d e f g h j " * 2, "* # $ <>|&% *", "l\nl\n\n \nl"]
    docs = odd.union(spark.createDataFrame([(50 + i, t, "a", 1) for i, t in enumerate(texts)], odd.schema))
    for row, given in zip(quality.judge(docs, _labels(spark)).orderBy("doc_id", "n_words").collect(), docs.orderBy("doc_id").collect(), strict=True):
        if row["doc_id"] is None:
            continue
        want = _base(given["text"])
        assert {k: row[k] for k in want} == want
        assert row["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])


def test_scores_separate_marks_from_prose(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(60)), "a", 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"WORD{(i * 7 + k) % 50}!!" for k in range(60)), "a", 1) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, source string, kept int")
    found = {r["doc_id"]: (r["score"], r["kept"], r["base_failed"]) for r in quality.judge(docs, _labels(spark, range(0, 100))).collect()}
    assert min(found[i][0] for i, *_ in good) > 0 > max(found[i][0] for i, *_ in bad)
    assert not any(found[i][1] for i, *_ in bad)


def test_no_labels_rejects_by_base_rules_only(spark, odd, nothing):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r["kept"] is not r["base_failed"] and r["score"] == 0 for r in quality.judge(odd, empty).collect())
    assert quality.judge(nothing, empty).collect() == []


def _templates(rows, min_docs=2):
    """Brute force of the template tree over distinct (doc_id, text)."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=str)
    lines = []
    for key in docs:
        for at, line in enumerate((key[1] or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in _words(line))
            if len(tokens) >= 5:
                lines.append((key, at, tokens))
    leaves = defaultdict(set)
    for _, _, t in lines:
        leaves[len(t), t[:3]].add(t)
    general = {}
    for texts in leaves.values():
        for t in texts:
            fields = [i for i in range(len(t)) if sum(o[i] == t[i] for o in texts) == 1] if len(texts) > 1 else []
            if fields and len(fields) <= len(t) * 0.2 + 1e-9:
                general[t] = (t[:3], tuple("<*>" if i in fields else x for i, x in enumerate(t)))
    docs_of = defaultdict(set)
    for key, _, t in lines:
        docs_of[general.get(t, t)].add(key)
    drops = defaultdict(set)
    for key, at, t in lines:
        those = docs_of[general.get(t, t)]
        low = min(k[0] if k[0] is not None else 1 << 62 for k in those)
        if len(those) >= min_docs and key[0] != low:
            drops[key].add(at)
    out = []
    for r in rows:
        parts = None if r[1] is None else r[1].split("\n")
        gone = drops.get((r[0], r[1]), set())
        text = None if parts is None else "\n".join(x for i, x in enumerate(parts) if i not in gone)
        out.append((r[0], text, len(parts or []), len(gone)))
    return Counter(out)


def test_line_templates(spark, odd):
    more = [
        (20, "Page 3 of 9 in the printed book\nUnique words stand on this one line", "a", 1),
        (21, "Page 4 of 12 in the printed book", "a", 1),
        (22, "See the report that Smith wrote about all these many other things here", "a", 1),
        (23, "See the report that Jones wrote about all these many other things here", "a", 1),
        (24, "See the report of quite another kind with no more words in common", "a", 1),
        (25, "short line\nshort line", "a", 1),
        (26, "short line", "a", 1),
    ]
    docs = odd.union(spark.createDataFrame(more, odd.schema))
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == ["doc_id", "source", "kept", "text", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in kept.collect())
    assert got == _templates([tuple(r) for r in docs.collect()])
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert by_id[21]["text"] == "" and by_id[23]["text"] == "" and by_id[24]["n_dropped"] == 0
    assert by_id[25]["n_dropped"] == by_id[26]["n_dropped"] == 0


def test_line_dedup_empty(nothing):
    assert line_dedup.drop_lines(nothing).collect() == []


def _linked_drops(rows, min_docs=2):
    """Brute force of the linked templates over rows of unique doc_id: places dropped by document."""
    lines = []
    for doc_id, text, *_ in rows:
        for at, line in enumerate((text or "").split("\n")):
            tokens = _words(line)
            if tokens:
                lines.append((doc_id, at, tuple("<*>" if len(tokens) >= 5 and re.search("[0-9]", t) else t for t in tokens)))
    texts = sorted({t for _, _, t in lines})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    leaves = defaultdict(list)
    for t in texts:
        leaves[len(t), t[:3]].append(t)
    for own in leaves.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if 5 * sum(x != y for x, y in zip(a, b, strict=True)) <= len(a):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    docs_of = defaultdict(set)
    for doc_id, _, t in lines:
        docs_of[find(t)].add(doc_id)
    drops = defaultdict(set)
    for doc_id, at, t in lines:
        if len(docs_of[find(t)]) >= min_docs and doc_id != min(docs_of[find(t)]):
            drops[doc_id].add(at)
    return {d: frozenset(p) for d, p in drops.items()}


@pytest.mark.parametrize("size", [40, 400])
def test_linked_lines_with_recurring_field_values(spark, size):
    rng = random.Random(size)
    names, cities = [f"Name{chr(97 + i)}" for i in range(9)], ["Oslo", "Bern", "Rome"]
    rows = []
    for i in range(size):
        body = " ".join(rng.choices("abcdefgh", k=12))
        twin = f"one two three {' '.join(rng.choices('kl', k=7))}"
        rows.append((i, f"Dear reader please write to {rng.choice(names)} in our {rng.choice(cities)} office\n{body}\n{twin}\nnumber {i}", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept int")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_lines(docs, linked=True).collect() if r["n_dropped"]}
    assert got == {d: len(p) for d, p in _linked_drops(rows).items()}
    kept = [r["text"] for r in line_dedup.drop_lines(docs, linked=True).collect()]
    assert sum("Dear reader" in t for t in kept) == 1 and all("number" in t for t in kept)


@pytest.mark.parametrize("large", [line_dedup.LARGE, 60])
def test_links_of_large_groups(spark, large):
    rng = random.Random(3)
    texts = set()
    for family in range(3):
        base = [f"f{family % 2}{i}" for i in range(20)]
        for _ in range(150):
            own = list(base)
            for p in rng.sample(range(20), rng.randrange(9)):
                own[p] = rng.choice(["x", "y", "z"])
            texts.add(("l", "l", "l", *own))
    texts |= {("m", "m", "m", *rng.choices("uv", k=k)) for k in (2, 7, 12) for _ in range(200)}
    texts = [*texts]
    lines = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "_whole bigint, _tokens array<string>").withColumn("_leaf", line_dedup._leaf())
    found = {r["node"]: r["root"] for r in line_dedup.components(line_dedup.line_links(lines, cell=4, large=large)).collect()}
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if len(a) == len(texts[j]) and a[:3] == texts[j][:3] and 5 * sum(x != y for x, y in zip(a, texts[j], strict=True)) <= len(a):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert found == {i: r for i, r in enumerate(root) if r != i}


def test_linked_lines_odd_rows(spark, odd, nothing):
    kept = line_dedup.drop_lines(odd, linked=True)
    assert kept.count() == odd.count() and line_dedup.drop_lines(nothing, linked=True).collect() == []


def test_linked_lines_of_few_tokens(spark):
    rows = [
        (1, "All rights reserved.\nHome\n3\nPage 4\n\n \nown words", "a", 1),
        (2, "All  rights reserved.\nHome\n4\nPage 5\n\n \nother words", "a", 1),
        (3, "Home\nPage 5\nAll rights", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, kept int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, linked=True).collect()}
    assert got == {1: rows[0][1], 2: "4\nPage 5\n\n \nother words", 3: "All rights"}
    assert {d: len(p) for d, p in _linked_drops(rows).items()} == {2: 2, 3: 2}


def test_links_grow_with_the_lines_of_a_leaf(spark):
    counts = []
    for n in (300, 600, 1200):
        rng, texts = random.Random(n), set()
        while len(texts) < n:
            own = [f"t{i}" for i in range(20)]
            for p in rng.sample(range(3, 20), rng.randrange(7)):
                own[p] = f"w{rng.randrange(50)}"
            texts.add(tuple(own))
        lines = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "_whole bigint, _tokens array<string>").withColumn("_leaf", line_dedup._leaf())
        counts.append(line_dedup.line_links(lines).count())
    # Hubs of a round link to all their lines; beyond that a line brings few links, whatever its leaf holds.
    assert all(c <= 40 * n for c, n in zip(counts, (300, 600, 1200), strict=True)) and counts[2] < 6 * counts[0]
