from __future__ import annotations

import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.functions.models import ModelPorts, digest
from lorebase.functions.text import ordered_lines
from lorebase.functions.arrow import arrow_function
from lorebase.operators import boilerplate, changes, crawl, dedup, evaluation, knn, ordering, packing, retrieval, summaries
from pyspark.sql import types as T

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# -- order ------------------------------------------------------------------------------


def test_running_sum_with_a_hot_group(spark):
    data = [("hot", i * 3, i % 7) for i in range(400)] + [("cold", i, 1) for i in range(5)]
    df = spark.createDataFrame(data, "g string, o long, v long")
    got = {(r.g, r.o): r.s for r in ordering.running_sum(df, ["g"], "o", "v", "s", ranges=8).collect()}
    for g in ("hot", "cold"):
        total = 0
        for name, o, v in sorted(d for d in data if d[0] == g):
            total += v
            assert got[name, o] == total


def test_positions_are_dense(spark):
    df = spark.range(0, 500, 5).select(F.col("id").alias("o"))
    got = [r.position for r in ordering.positions(df, [], "o", ranges=7).orderBy("o").collect()]
    assert got == list(range(100))


def test_sorted_positions_by_text(spark):
    df = spark.createDataFrame([("c", f"{i:05d}/x") for i in range(300)] + [("d", "b"), ("d", "a")], "c string, p string")
    got = {(r.c, r.p): r.position for r in ordering.sorted_positions(df, "c", "p", ranges=5).collect()}
    assert got["c", "00123/x"] == 123 and got["d", "a"] == 0 and got["d", "b"] == 1


@FEW
@given(st.lists(st.floats(-100, 100).map(lambda x: round(x, 1)), min_size=1, max_size=40))
def test_median(spark, values):
    df = spark.createDataFrame([("m", v) for v in values], "k string, v double")
    assert ordering.exact_median(df, ["k"], "v").first()["median"] == pytest.approx(statistics.median(values))


def test_batches(spark):
    df = spark.createDataFrame([(i,) for i in (3, 9, 11, 20, 21, 22, 40)], "o long")
    assert [r.batch_no for r in ordering.batch_number(df, "o", 3).orderBy("o").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_keep_first_and_last(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, pos int")
    assert rows(dedup.keep_first(df, ["k"], "pos"), "k", "pos") == [("a", 1), ("b", 2)]
    assert rows(dedup.keep_last(df, ["k"], "pos"), "k", "pos") == [("a", 3), ("b", 2)]
    plan = dedup.keep_first(df, ["k"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a hot key sends one row per task


# -- neighbours ---------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_nearest_equals_brute_force_with_a_hot_collection(spark, metric):
    rng = np.random.default_rng(1)
    stored = [("hot" if i % 3 else f"c{i % 5}", f"v{i:03d}", rng.normal(size=6).round(2).tolist()) for i in range(150)]
    stored += [("hot", f"copy{i}", stored[1][2]) for i in range(9)]
    asked = [(c, f"q{i}", rng.normal(size=6).round(2).tolist()) for i in range(12) for c in ("hot", "c0", "none")]
    store = spark.createDataFrame(stored, "collection string, id string, embedding array<double>")
    questions = spark.createDataFrame(asked, "collection string, query_id string, embedding array<double>")
    got = {}
    for r in knn.nearest(store, questions, 4, metric, block_rows=7).collect():
        got.setdefault((r.query_id, r.collection), []).append((r["rank"], r.id))
    want = {}
    for collection, query_id, q in asked:
        line = []
        for c, i, v in stored:
            if c == collection:
                q_, v_ = np.array(q), np.array(v)
                d = {"ip": 1 - q_ @ v_, "l2": ((q_ - v_) ** 2).sum(), "cosine": 1 - q_ @ v_ / np.sqrt((q_ @ q_) * (v_ @ v_))}[metric]
                line.append((round(float(d), 10), i))
        if line:
            want[query_id, collection] = [(n + 1, i) for n, (_, i) in enumerate(sorted(line)[:4])]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_nearest_without_broadcast(spark):
    rng = np.random.default_rng(2)
    stored = [("hot" if i % 4 else "cold", f"v{i:03d}", rng.normal(size=5).tolist()) for i in range(300)]
    store = spark.createDataFrame(stored, "collection string, id string, embedding array<double>")
    asked = store.withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    broadcast = key(knn.nearest(store, asked, 3, block_rows=16))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        shuffled = knn.nearest(store, asked, 3, block_rows=16)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert key(shuffled) == broadcast and len(broadcast) == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nearest_rejects_bad_input(spark):
    a = spark.createDataFrame([("c", "1", [1.0, 2.0])], "collection string, id string, embedding array<double>")
    with pytest.raises(ValueError):
        knn.nearest(a, a.withColumnRenamed("id", "query_id"), 1, "hamming")
    q = spark.createDataFrame([("c", "1", [1.0])], "collection string, query_id string, embedding array<double>")
    with pytest.raises(Exception, match="differ in dimension"):
        knn.nearest(a, q, 1).collect()


def test_zero_vector_has_distance_one():
    assert knn.distance_matrix(np.zeros((1, 2)), np.ones((1, 2)), "cosine")[0, 0] == 1.0


# -- contexts --------------------------------------------------------------------------------


def results(spark, data):
    meta = "struct<documentId: string, source: string, type: string, title: string, embeddingType: string, chunkIndex: int, uri: string>"
    full = [(q, c, f"{c}{r}", d, r, text, (f"d{r}", src, "k", "t", "chunk", r, uri)) for q, c, r, d, text, src, uri in data]
    return spark.createDataFrame(full, f"query_id string, collection string, id string, distance double, rank int, document string, metadata {meta}")


def test_threshold_boundary_and_missing_distance(spark, rows):
    df = results(spark, [("q", "c", 1, 0.7, "a", "s1", None), ("q", "c", 2, 0.70001, "b", "s2", None), ("q", "c", 3, None, "c", "s3", None)])
    assert rows(retrieval.passing(df, 0.3), "id") == [("c1",)]
    assert rows(retrieval.passing(df, 0.0), "id", "distance")[-1] == ("c3", 1.0)


def test_guidance_orders_dedups_and_numbers(spark):
    df = results(spark, [
        ("q", "a", 1, 0.4, "x" * 10, "s1", None), ("q", "b", 1, 0.1, "y" * 10, "s1", None), ("q", "b", 2, 0.4, "z" * 10, "s2", None),
        ("q", "a", 2, 0.5, "u" * 10, "", None), ("q", "b", 3, 0.5, "v" * 10, "", None), ("q", "a", 3, 0.95, "w", "s9", None),
    ])
    order = F.when(F.col("collection") == "a", 0).otherwise(1)
    kept = retrieval.guidance_results(df, order, n=5, min_score=0.3, budget=1000)
    assert [(r.position, r.id) for r in kept.orderBy("position").collect()] == [(0, "b1"), (1, "b2"), (2, "a2"), (3, "b3")]
    assert retrieval.guidance_results(df, order, n=2).count() == 2
    text = retrieval.contexts(kept, "\n\n").first()["context"]
    assert text.startswith("[source:0] " + "y" * 10 + "\n\n[source:1] ")


def test_missing_source_counts_as_the_collection(spark):
    df = results(spark, [("q", "a", 1, 0.1, "x", None, None), ("q", "a", 2, 0.2, "y", None, None)])
    kept = retrieval.guidance_results(df, F.lit(0))
    assert [r.source for r in kept.collect()] == ["a"]


@FEW
@given(st.lists(st.integers(0, 30), min_size=1, max_size=8), st.integers(0, 60))
def test_budget_is_the_longest_fitting_prefix(spark, lengths, budget):
    df = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate(lengths)], "query_id string, position int, document string")
    want, used = [], 0
    for i, n in enumerate(lengths):
        if used + n > budget:
            break
        want.append(i)
        used += n
    assert sorted(r.position for r in retrieval.within_budget(df, budget).collect()) == want


def test_sources_merge_blanks_and_fall_back(spark):
    df = results(spark, [("q", "c", 1, 0.1, "a", "", "u1"), ("q", "c", 2, 0.2, "b", None, ""), ("q", "c", 3, 0.3, "c", "s", "")])
    found = retrieval.first_per_source(retrieval.expert_results(df, 0.0)).orderBy("position").collect()
    assert [(r.source, r.uri, round(r.score, 2)) for r in found] == [("", "u1", 0.9), ("s", "s", 0.7)]


# -- change detection --------------------------------------------------------------------------


def chunks(spark, data):
    full = [("c", d, f"h-{d}-{t}", "chunk", i, t) for d, i, t in data]
    return spark.createDataFrame(full, "collection string, document_id string, content_hash string, embedding_type string, chunk_index int, content string")


def held(spark, data):
    full = [("c", i, (d, kind), [1.0, 2.0]) for i, d, kind in data]
    return spark.createDataFrame(full, "collection string, id string, metadata struct<documentId: string, embeddingType: string>, embedding array<float>")


def listed(spark, *ids):
    return spark.createDataFrame([("c", i) for i in ids], "collection string, document_id string")


def states(diff):
    return sorted((r.document_id, r.id, r.status, r.copies) for r in diff.collect())


def test_four_states(spark):
    now = chunks(spark, [("d1", 0, "a"), ("d1", 1, "a"), ("d2", 0, "new")])
    store = held(spark, [("h-d1-a", "d1", "chunk"), ("h-d2-old", "d2", "chunk"), ("h-d3-x", "d3", "chunk"), ("d3-summary-0", "d3-summary", "summary")])
    diff = changes.difference(now, store, listed(spark, "d1", "d2"))
    assert states(diff) == [
        ("d1", "h-d1-a", "unchanged", 2), ("d2", "h-d2-new", "new", 1), ("d2", "h-d2-old", "orphan", 0), ("d3", "h-d3-x", "removed", 0),
    ]
    assert [r.document_id for r in changes.changed_documents(diff).collect()] == ["d2"]
    assert [r.document_id for r in changes.removed_documents(diff).collect()] == ["d3"]


def test_orphan_alone_marks_the_document_changed(spark):
    diff = changes.difference(chunks(spark, [("d1", 0, "keep")]), held(spark, [("h-d1-keep", "d1", "chunk"), ("h-d1-gone", "d1", "chunk")]))
    assert [r.document_id for r in changes.changed_documents(diff).collect()] == ["d1"]
    assert [r.id for r in changes.orphan_ids(diff).collect()] == ["h-d1-gone"]


def test_listed_document_without_chunks_keeps_its_rows(spark):
    diff = changes.difference(chunks(spark, [("d1", 0, "a")]), held(spark, [("h-d2-x", "d2", "chunk")]), listed(spark, "d1", "d2"))
    assert states(diff) == [("d1", "h-d1-a", "new", 1)]


def test_nothing_now_removes_everything(spark):
    diff = changes.difference(chunks(spark, [("d", 0, "a")]).limit(0), held(spark, [("h", "d1", "chunk"), ("d1-summary-0", "d1-summary", "summary")]))
    assert states(diff) == [("d1", "h", "removed", 0)]


def test_unchanged_chunks_get_the_stored_vector(spark):
    marked = changes.reuse_embeddings(chunks(spark, [("d1", 0, "a"), ("d1", 1, "b")]), held(spark, [("h-d1-a", "d1", "chunk")]))
    assert sorted((r.content, r.unchanged, r.embedding) for r in marked.collect()) == [("a", True, [1.0, 2.0]), ("b", False, None)]


def test_stale_and_due_summaries(spark):
    now = chunks(spark, [("big", i, str(i)) for i in range(4)] + [("small", 0, "x"), ("same", 0, "y")])
    changed = listed(spark, "big", "small")
    assert [r.document_id for r in changes.summary_candidates(now, changed).collect()] == ["big"]
    assert [r.id for r in changes.stale_summaries(now, changed).collect()] == ["small-summary-0"]
    assert changes.summary_candidates(now, changed.limit(0)).isEmpty()
    assert [r.document_id for r in changes.summary_candidates(now, None).collect()] == ["big"]


# -- boilerplate ---------------------------------------------------------------------------------


def pages(spark, texts):
    return spark.createDataFrame([("site", i, t) for i, t in enumerate(texts)], "site string, page_id int, content string")


def test_recurring_paragraphs_go(spark):
    shared = "This is our cookie policy notice that appears everywhere."
    texts = [f"Unique content for page {i} with enough length.\n\n{shared.upper() if i % 2 else shared}" for i in range(6)]
    got = {r.page_id: r.content for r in boilerplate.without_boilerplate(pages(spark, texts)).collect()}
    assert got == {i: f"Unique content for page {i} with enough length." for i in range(6)}


def test_few_pages_half_share_short_and_emptied(spark):
    shared = "Repeated paragraph on every single page."
    few = [f"Page {i} content.\n\n{shared}" for i in range(3)]
    assert sorted(r.content for r in boilerplate.without_boilerplate(pages(spark, few)).collect()) == few
    half = [f"Page number {i}\n\n{shared}" if i < 2 else f"Page number {i}" for i in range(4)]
    assert sorted(r.content for r in boilerplate.without_boilerplate(pages(spark, half)).collect()) == half
    short = [f"Short\n\nActual content that is unique for page {i}." for i in range(5)]
    assert sorted(r.content for r in boilerplate.without_boilerplate(pages(spark, short)).collect()) == short
    emptied = [shared] + [f"Own text of page {i}\n\n{shared}" for i in range(4)]
    assert boilerplate.without_boilerplate(pages(spark, emptied)).count() == 4


# -- packing and summaries -----------------------------------------------------------------------


def packed_by_loop(lengths, limit):
    groups, size, number = [], 0, -1
    for n in lengths:
        if number < 0 or size + n > limit:
            number, size = number + 1, 0
        groups.append(number)
        size += n
    return groups


@FEW
@given(st.lists(st.one_of(st.integers(0, 400), st.just(0), st.integers(900, 1500)), min_size=1, max_size=60), st.integers(1, 9))
def test_packing_equals_the_loop(spark, lengths, block):
    data = [("a", i * 2, "x" * n) for i, n in enumerate(lengths)] + [("b", 7, "y")]
    df = spark.createDataFrame(data, "collection string, order_key long, text string")
    got = sorted((r.collection, r.order_key, r.group_no) for r in packing.assign_groups(df, 1000, block).collect())
    assert got == [("a", i * 2, g) for i, g in enumerate(packed_by_loop(lengths, 1000))] + [("b", 7, 0)]


def test_block_functions_against_the_loop():
    import pandas as pd

    rng = np.random.default_rng(3)
    for trial in range(200):
        lengths = rng.choice([0, 1, 5, 9, 30, 120], size=rng.integers(1, 50)).tolist()
        limit, block = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        frame = pd.DataFrame({"position": range(len(lengths)), "order_key": range(len(lengths)), "length": lengths})
        frame["block"] = frame["position"] // block
        parts = pd.concat([packing._summarise(limit)(("c", b), g) for b, g in frame.groupby("block")])
        edges = packing._walk(limit)(("c",), parts)
        joined = frame.merge(edges, on="block")
        out = pd.concat([packing._number(limit)(("c", b), g) for b, g in joined.groupby("block")]).sort_values("order_key")
        assert out["group_no"].tolist() == packed_by_loop(lengths, limit)


def doc_chunks(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "document_id string, chunk_index int, content string")


def ports(map_text=None, reduce_text=None):
    @arrow_function(T.StringType())
    def mapped(texts, budgets):
        import pandas as pd

        return pd.Series([(map_text or (lambda t, b: f"{t}:{b}"))(t, int(b)) for t, b in zip(texts, budgets)], dtype="object")

    @arrow_function(T.StringType())
    def reduced(texts, budgets):
        return texts.map(lambda t: None if t is None else (reduce_text or (lambda x: "[" + x.replace("\n\n---\n\n", "+") + "]"))(t))

    return ModelPorts(map_text=mapped, reduce_text=reduced)


def summary(df, model, **options):
    found = summaries.map_reduce(df, ["document_id"], "chunk_index", "content", model, **options).collect()
    return found[0].summary if found else None


def test_tree_reduce_shape(spark):
    seven = doc_chunks(spark, *"abcdefg")
    assert summary(seven, ports(lambda t, b: t), fanin=3) == "[[a+b+c]+[d+e+f]+g]"
    plan = summaries.call_plan(seven, ["document_id"], 3).orderBy("level").collect()
    assert [(r.level, r.n_in, r.calls, r.n_out) for r in plan] == [(1, 7, 2, 3), (2, 3, 1, 1)]


def test_single_chunk_gets_the_whole_budget_and_no_reduce(spark):
    assert summary(doc_chunks(spark, "a"), ports(), max_length=2000) == "a:2000"
    assert summary(doc_chunks(spark, "a", "b"), ports(), max_length=2000) == "[a:1000+b:1000]"
    assert summary(doc_chunks(spark, *"abcd"), ports(reduce_text=lambda x: x[-3:]), max_length=2000) == "500"


def test_failed_maps_are_left_out_and_failed_merges_joined(spark):
    some = ports(lambda t, b: {"b": None, "c": ""}.get(t, t), lambda x: None)
    assert summary(doc_chunks(spark, *"abcde"), some, fanin=2) == "a\n\n---\n\nd\n\n---\n\ne"
    assert summary(doc_chunks(spark, "a", "b"), ports(lambda t, b: None)) is None
    with pytest.raises(ValueError):
        summary(doc_chunks(spark, "a"), ports(), fanin=1)
    assert summary(doc_chunks(spark, *"abcdefg"), ports(lambda t, b: t), fanin=3, bounded=False) == "[[a+b+c]+[d+e+f]+g]"


def test_refine(spark):
    def step(so_far, chunk, budget):
        if chunk == "boom":
            raise RuntimeError("down")
        return f"{so_far}|{chunk}:{budget}"

    def fold(*texts):
        return summaries.refine(doc_chunks(spark, *texts), "document_id", "chunk_index", "content", step, 100).first()["summary"]

    assert fold("a") == "|a:100"
    assert fold("a", "b", "c") == "|a:40|b:70|c:100"
    assert fold("a", "boom", "c") == "|a:40"
    with pytest.raises(Exception, match="down"):
        fold("boom", "a")


def test_refine_holds_one_batch_of_a_huge_document(spark):
    def step(so_far, chunk, budget):
        import resource

        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        first, n, _ = (so_far or f"{peak},0,0").split(",")
        return f"{first},{int(n) + 1},{peak}"

    chunks = spark.range(3000).select(F.lit("d").alias("document_id"), F.col("id").alias("chunk_index"), F.repeat(F.lit("x"), F.lit(200_000)).alias("content"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        first, n, last = map(int, summaries.refine(chunks, "document_id", "chunk_index", "content", step).first()["summary"].split(","))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert n == 3000 and last - first < 200  # MB, of 600


@given(st.text(alphabet="ab c\n", max_size=80), st.integers(1, 40))
def test_digest_fits_and_keeps_short_texts(text, budget):
    out = digest(text, budget)
    assert len(out) <= budget
    assert out == text if len(text) <= budget else set(out.split()) <= set(text.split())


def test_sections_prefer_summaries(spark):
    docs = spark.createDataFrame([("c", "d1", 2), ("c", "d2", 1), ("c", "d3", 3)], "collection string, document_id string, position long")
    some = chunks(spark, [("d1", 1, "b"), ("d1", 0, "a"), ("d2", 0, "z")])
    sums = spark.createDataFrame([("c", "d2", "SUM")], "collection string, document_id string, summary string")
    got = [(r.document_id, r.text) for r in summaries.sections(docs, some, sums).orderBy("order_key").collect()]
    assert got == [("d2", "SUM"), ("d1", "a\nb")]


def test_ordered_lines(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (10, "c")], "o int, t string")
    assert df.agg(ordered_lines(F.col("o"), F.col("t"), ";").alias("x")).first()["x"] == "a;b;c"


def test_recurring_paragraphs_go_without_broadcasts(spark):
    shared = "This is our cookie policy notice that appears everywhere."
    rows_ = [("a", i, f"Page {i}, first part\n\n{shared}\n\nPage {i}, last part") for i in range(6)]
    rows_ += [("b", i, f"{shared}\n\nOther site {i}") for i in range(3)] + [("a", 9, None), ("c", 1, "  ")]
    given = spark.createDataFrame(rows_, "site string, page_id int, content string")
    want = {("a", i): f"Page {i}, first part\n\nPage {i}, last part" for i in range(6)}
    want |= {("b", i): f"{shared}\n\nOther site {i}" for i in range(3)}  # too few pages to judge
    read = lambda: {(r.site, r.page_id): r.content for r in boilerplate.without_boilerplate(given).collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert read() == want
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert read() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# -- crawl --------------------------------------------------------------------------------------


def test_one_link_for_a_repeated_attribute(spark):
    page = spark.createDataFrame([("http://a.com/", '<a href="/x" href="/y">l</a><a>n</a><a href>e</a>')], "url string, html string")
    assert [r.target for r in crawl.page_links(page).orderBy("link_pos").collect()] == ["http://a.com/y", "http://a.com/"]


def test_hot_collections_are_few_and_every_pair_meets_once(spark):
    store = spark.createDataFrame([("hot", str(i), [float(i)]) for i in range(90)] + [(f"c{i}", "x", [1.0]) for i in range(10)],
                                  "collection string, id string, embedding array<double>")
    hot = knn.hot_collections(store).collect()
    assert [(r.collection, r.cells) for r in hot] == [("hot", 2)]  # two shuffle partitions: 90 rows of a share of 50
    left = spark.createDataFrame([("hot", [str(i)]) for i in range(20)], "s_collection string, s_ids array<string>")
    right = spark.createDataFrame([("hot", [str(i)]) for i in range(20)], "q_collection string, q_ids array<string>")
    pairs = knn._grid(left, right, knn.hot_collections(store), F.col("s_collection") == F.col("q_collection"))
    assert pairs.count() == 400 == pairs.select("s_ids", "q_ids").distinct().count()


def link_page(url, *targets, **extra):
    return {"url": url, "html": "<p>x</p>" + "".join(f'<a href="{t}">l</a>' for t in targets), "content_type": "text/html; charset=utf-8", "final_url": url, **extra}


SITE = [
    link_page("http://a.com/", "/b", "/c#frag", "http://other.com/", "/file.pdf", "/missing", "mailto:x@y.z"),
    link_page("http://a.com/b", "/d", "/", "c/"),
    link_page("http://a.com/c", "e", "/b"),
    link_page("http://a.com/d"),
    link_page("http://a.com/e", content_type="application/json"),
    link_page("http://b.com/", "/x"), link_page("http://b.com/x", final_url="http://b.com/moved/"),
]


def crawled(spark, seeds, **options):
    schema = "url string, html string, content_type string, final_url string"
    table = spark.createDataFrame([tuple(p[c] for c in ("url", "html", "content_type", "final_url")) for p in SITE], schema)
    found = crawl.crawl(table, spark.createDataFrame([(s,) for s in seeds], "base_url string"), **options)
    out = {}
    for r in found.orderBy("base_url", "rank").collect():
        out.setdefault(r.base_url, []).append(r.url)
    return out


def test_crawl_is_breadth_first_per_site(spark):
    got = crawled(spark, ["http://a.com", "http://b.com/"])
    assert got == {
        "http://a.com": ["http://a.com/", "http://a.com/b", "http://a.com/c", "http://a.com/d"],
        "http://b.com/": ["http://b.com/", "http://b.com/moved"],
    }


def test_crawl_limit_and_dead_seeds(spark):
    assert crawled(spark, ["http://a.com"], page_limit=2) == {"http://a.com": ["http://a.com/", "http://a.com/b"]}
    assert crawled(spark, ["http://127.0.0.1/", "http://nowhere.com/", "http://a.com/e"]) == {}
    table = spark.createDataFrame([(p["url"], p["html"]) for p in SITE], "url string, html string")
    seeds = spark.createDataFrame([("http://nowhere.com",), ("http://a.com#x",)], "base_url string")
    assert [r.base_url for r in crawl.unreachable(table, seeds).collect()] == ["http://nowhere.com"]


# -- evaluation -----------------------------------------------------------------------------------


def test_aggregate_and_finite(spark):
    df = spark.createDataFrame([("f", 0.6), ("f", 0.8), ("f", 1.0), ("g", float("nan")), ("g", float("inf"))], "metric string, score double")
    got = {r.metric: r for r in evaluation.aggregate(df.withColumn("score", evaluation.finite(F.col("score"))), []).collect()}
    assert got["f"].mean == pytest.approx(0.8) and got["f"].median == pytest.approx(0.8) and (got["f"].min, got["f"].max) == (0.6, 1.0)
    assert got["g"].mean == 0.0


def test_comparison_with_zero_baseline_and_missing_metrics(spark):
    b = spark.createDataFrame([("a", 0.5), ("z", 0.0), ("only", 1.0)], "metric string, mean double")
    c = spark.createDataFrame([("a", 0.4), ("z", 0.3)], "metric string, mean double")
    deltas = evaluation.compare(b, c)
    got = {r.metric: (round(r.absolute_delta, 6), round(r.percentage_change, 6)) for r in deltas.collect()}
    assert got == {"a": (-0.1, -20.0), "z": (0.3, 0.0)}
    assert tuple(evaluation.verdict(deltas).first()) == (2, 1, 1)


def _chain(spark, depth, collection="c"):
    return spark.range(depth).select(
        F.lit(collection).alias("collection"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"),
        (F.col("id") % 3).cast("int").alias("pos"), F.concat(F.lit("n"), "id").alias("id"))


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    from lorebase.operators import tree

    rounds = []
    monkeypatch.setattr(tree, "checkpoint", lambda df, own=tree.checkpoint: rounds.append(1) or own(df))
    got = {r.id: (r.depth, r.path) for r in tree.space_paths(_chain(spark, 1000)).collect()}
    assert len(got) == 1000 and len(rounds) <= 12
    assert all(got[f"n{i}"][0] == i and got[f"n{i}"][1] == "/s".join(str(k % 3).zfill(20) for k in range(i + 1)) for i in (0, 1, 2, 7, 500, 999))


def test_paths_of_odd_trees(spark):
    from lorebase.operators.tree import space_paths

    rows = [("c", None, 0, "a"), ("c", "a", 1, "b"), ("c", "b", 0, "a"), ("c", "x", 0, "y"), ("c", "y", 0, "x"), ("c", "gone", 0, "orphan"), ("d", None, 2, "a"), ("d", "a", 0, "b")]
    got = sorted((r.collection, r.id, r.depth) for r in space_paths(spark.createDataFrame(rows, "collection string, parent_id string, pos int, id string")).collect())
    assert got == [("c", "a", 0), ("c", "b", 1), ("d", "a", 0), ("d", "b", 1)]
    assert space_paths(spark.createDataFrame([], "collection string, parent_id string, pos int, id string")).isEmpty()
