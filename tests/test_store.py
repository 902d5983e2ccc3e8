from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function
from lorebase.functions.models import ModelPorts
from lorebase.plans import answer, ingest
from lorebase.sources.store import ROW, KnowledgeStore


def rows_of(spark, data):
    full = [(c, i, text, (doc, "s", "knowledge", "t", kind, 0, None), [float(x) for x in vec]) for c, i, text, doc, kind, vec in data]
    return spark.createDataFrame(full, ROW)


@pytest.fixture
def store(spark, tmp_path):
    return KnowledgeStore(spark, str(tmp_path / "store"), buckets=4)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_upsert_replaces_by_id_and_keeps_versions(spark, store):
    assert store.version() == 0 and store.read().isEmpty()
    store.upsert(rows_of(spark, [("a", "1", "one", "d1", "chunk", [1, 0]), ("a", "2", "two", "d2", "chunk", [0, 1]), ("b/x:y", "1", "other", "d1", "chunk", [1, 1])]))
    store.upsert(rows_of(spark, [("a", "1", "ONE", "d1", "chunk", [1, 0]), ("a", "3", "three", "d3", "chunk", [1, 1])]))
    assert store.version() == 2
    assert sorted((r.id, r.document) for r in store.read(["a"]).collect()) == [("1", "ONE"), ("2", "two"), ("3", "three")]
    assert ids(store.read(["b/x:y"])) == ["1"]
    assert sorted(r.document for r in store.read(["a"], version=1).collect()) == ["one", "two"]


def test_only_touched_buckets_are_rewritten(spark, store):
    store.upsert(rows_of(spark, [("a", str(i), "t", f"d{i}", "chunk", [1, 0]) for i in range(20)]))
    before = store._folders()
    store.upsert(rows_of(spark, [("a", "x", "t", "d1", "chunk", [1, 0])]))
    after = store._folders()
    assert sum(before[k] != after[k] for k in before) == 1


def test_get_filters_and_projects(spark, store):
    store.upsert(rows_of(spark, [("a", "1", "one", "d1", "chunk", [1, 0]), ("a", "2", "two", "d1", "summary", [0, 1]), ("a", "3", "three", "d2", "chunk", [1, 1])]))
    assert ids(store.get("a", ids=["1", "9"])) == ["1"]
    found = store.get("a", where={"documentId": "d1"}, include=["metadata"])
    assert ids(found) == ["1", "2"] and found.columns == ["id", "metadata"]
    assert ids(store.get("a", where={"embeddingType": "summary"})) == ["2"]
    assert ids(store.get("none")) == []
    assert store.exists("a", "d2") and not store.exists("a", "d9")
    plan = store.get("a", where={"embeddingType": "summary"}, include=[])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(metadata.embeddingType,summary)" in plan and "embedding:" not in plan


def test_deletes(spark, store):
    data = [("a", "1", "x", "d1", "chunk", [1, 0]), ("a", "2", "x", "d2", "chunk", [1, 0]), ("a", "s", "x", "d2-summary", "summary", [1, 0]), ("b", "1", "x", "d1", "chunk", [1, 0])]
    store.upsert(rows_of(spark, data))
    store.delete_ids(spark.createDataFrame([("a", "1"), ("a", "unknown")], "collection string, id string"))
    assert ids(store.read(["a"])) == ["2", "s"] and ids(store.read(["b"])) == ["1"]
    store.delete_documents(spark.createDataFrame([("a", "d2")], "collection string, document_id string"))
    assert ids(store.read(["a"])) == []
    version = store.version()
    store.delete_where("a", documentId="d2")
    store.delete_collection("missing")
    assert store.version() == version
    store.delete_where("b", documentId="d1")
    assert store.read().isEmpty()


def test_embeddings_are_mandatory(spark, store):
    bad = rows_of(spark, [("a", "1", "x", "d", "chunk", [1])]).withColumn("embedding", F.lit(None).cast("array<float>"))
    with pytest.raises(ValueError):
        store.upsert(bad)
    with pytest.raises(ValueError):
        KnowledgeStore(spark, "x", metric="hamming")


def test_second_writer_of_a_version_fails(spark, store):
    store.upsert(rows_of(spark, [("a", "1", "x", "d", "chunk", [1])]))
    with pytest.raises(RuntimeError):
        store._publish(1, {})


# -- ingest ---------------------------------------------------------------------------------


def documents(spark, data, collection="c"):
    full = [(collection, d, f"src-{d}", "knowledge", f"T {d}", None, text, i) for i, (d, text) in enumerate(data)]
    return spark.createDataFrame(
        full, "collection string, document_id string, source string, type string, title string, uri string, content string, position long"
    )


LONG = " ".join(f"word{i}" for i in range(120))
BASE = [("d1", LONG), ("d2", "short text"), ("d3", "third text")]


def run(spark, store, data, **options):
    outcome = ingest.ingest(store, documents(spark, data), size=100, overlap=10, **options)
    return outcome, outcome.results.first()


def kinds(store):
    return sorted((r.metadata.documentId, r.metadata.embeddingType) for r in store.read(["c"]).filter("metadata.embeddingType <> 'chunk'").collect())


def test_first_ingest_then_unchanged(spark, store):
    outcome, first = run(spark, store, BASE)
    assert first.success and first.documents_processed == 3 and first.chunks_skipped == 0
    assert first.chunks_deleted == 2  # new small documents count as "summary no longer due", stored or not
    assert kinds(store) == [("body-of-knowledge-summary", "summary"), ("d1-summary", "summary")]
    assert first.chunks_stored == store.read().count()
    before = sorted((r.id, r.document) for r in store.read().collect())
    version = store.version()
    outcome, again = run(spark, store, BASE)
    assert again.chunks_stored == 0 and again.chunks_skipped == first.chunks_stored - 2 and again.chunks_deleted == 0
    assert outcome.metrics["embed"]["items_out"] == 0  # nothing is embedded twice
    assert store.version() == version and before == sorted((r.id, r.document) for r in store.read().collect())


def test_change_shrink_and_removal(spark, store):
    run(spark, store, BASE)
    _, result = run(spark, store, [("d1", "now it is short"), ("d2", "short text"), ("d4", "brand new")])
    assert result.success and result.chunks_skipped == 1
    assert kinds(store) == [("body-of-knowledge-summary", "summary")]
    found = sorted((r.metadata.documentId, r.document) for r in store.read().filter("metadata.embeddingType = 'chunk'").collect())
    assert found == [("d1", "now it is short"), ("d2", "short text"), ("d4", "brand new")]
    assert result.chunks_deleted > 3


def test_collections_are_independent(spark, store):
    both = documents(spark, BASE).unionByName(documents(spark, [("d2", "other collection")], "e"))
    outcome = ingest.ingest(store, both, size=100, overlap=10)
    assert {r.collection: r.documents_processed for r in outcome.results.collect()} == {"c": 3, "e": 1}
    run(spark, store, BASE[:1])
    assert [r.document for r in store.read(["e"]).filter("metadata.embeddingType = 'chunk'").collect()] == ["other collection"]


def test_errors_hold_back_the_clean_up(spark, store):
    run(spark, store, BASE)

    @arrow_function(T.ArrayType(T.FloatType()))
    def broken(texts):
        return texts.map(lambda t: None if "bad" in t else [1.0] * 64)

    outcome, result = run(spark, store, [("d1", LONG), ("d2", "bad text"), ("d3", "third text")], ports=ModelPorts(embed=broken), summarize=False)
    assert not result.success and result.chunks_deleted == 0
    assert store.read().filter("document = 'short text'").count() == 1  # the orphan stays
    messages = sorted(r.error for r in outcome.errors.collect())
    assert len(messages) == 2 and messages[0].startswith("orphan_cleanup: skipped (destructive step gated by 1")
    assert outcome.metrics["orphan_cleanup"]["error_count"] == 1
    event = ingest.website_result(outcome, "website", "knowledge", "p").first()
    assert event.result == "failure" and "; " in event.error and event.timestamp > 1_600_000_000_000


def test_blank_summary_is_an_error(spark, store):
    @arrow_function(T.StringType())
    def nothing(texts, budgets):
        return texts.map(lambda t: None)

    outcome, result = run(spark, store, BASE, ports=ModelPorts(map_text=nothing))
    assert not result.success
    assert "document_summary: no content for d1" in [r.error for r in outcome.errors.collect()]


def test_no_documents_left(spark, store):
    run(spark, store, BASE)
    assert ingest.empty_collection(store, "c") == 3
    assert kinds(store) == [("body-of-knowledge-summary", "summary")] and store.read().count() == 1


def test_website_documents(spark):
    shared = "This is our cookie policy notice that appears everywhere."
    page = "<title>T{0}</title><p>Unique text of the page number {0}.</p><p>More of the text {0}.</p><p>" + shared + "</p>"
    data = [("http://a.com:81/", f"http://a.com:81/{i}", page.format(i), i + 1) for i in range(5)]
    got = ingest.website_documents(spark.createDataFrame(data, "base_url string, url string, html string, rank int")).orderBy("position").collect()
    assert [r.title for r in got] == [f"T{i}" for i in range(5)] and got[0].collection == "a.com-81-knowledge"
    assert all(shared not in r.content and "Unique text" in r.content for r in got)


# -- answers ------------------------------------------------------------------------------------


@pytest.fixture
def filled(spark, store):
    docs = documents(spark, [("d1", "apples pears and plums"), ("d2", "trains and stations"), ("d3", "apples in spring")], "b1-knowledge")
    ingest.ingest(store, docs, summarize=False)
    return store


def test_expert_answers_with_sources(spark, filled):
    asked = spark.createDataFrame([("q1", "apples pears", "b1", "Fruit", "EN"), ("q2", "anything", "none", None, None)],
                                  "query_id string, message string, body_id string, display_name string, language string")
    got = {r.query_id: r for r in answer.expert(asked, filled).collect()}
    assert got["q1"].sources[0].documentId == "d1" and got["q1"].sources[0].score > 0.5 and "apples" in got["q1"].result
    assert got["q2"].sources == [] and got["q2"].result


def test_guidance_condenses_history(spark, filled):
    asked = spark.createDataFrame([("q1", "and trains", "DE", [("apples", "human"), ("yes", "assistant")]), ("q2", "apples", None, [])],
                                  "query_id string, message string, language string, history array<struct<content: string, role: string>>")
    got = {r.query_id: r for r in answer.guidance(asked, filled, ["b1-knowledge", "empty"], min_score=0.1).collect()}
    assert got["q1"].humanLanguage == "DE" and got["q2"].humanLanguage == "EN"
    assert {s.source for s in got["q2"].sources} <= {"src-d1", "src-d2", "src-d3"} and got["q2"].sources


def test_generic_and_assistant(spark):
    asked = spark.createDataFrame([("q", "hello", [], ["be kind"])], "query_id string, message string, history array<struct<content: string, role: string>>, prompt array<string>")
    assert "be kind" in answer.generic(asked).first().result
    who = spark.createDataFrame([("1", "m", None, "a", None), ("2", "m", "k", "", None), ("3", "m", "k", "a", "t9")],
                                "query_id string, message string, api_key string, assistant_id string, thread_id string")
    got = {r.query_id: r for r in answer.assistant(who).collect()}
    assert "API key" in got["1"].result and "assistantId" in got["2"].result and got["3"].threadId == "t9"


def test_expert_graph(spark, filled):
    definition = {
        "nodes": [{"name": "retrieve"}, {"name": "say", "input_variables": ["combined_knowledge_docs"], "prompt": "{combined_knowledge_docs}"}],
        "edges": [{"from": "START", "to": "retrieve"}, {"from": "retrieve", "to": "say"}, {"from": "say", "to": "END"}],
        "state": {"properties": [{"name": "combined_knowledge_docs", "type": "string"}, {"name": "result", "type": "string"}]},
    }
    asked = spark.createDataFrame([("q1", "apples", "b1", "EN", [("hi", "human")], "d", "n")],
                                  "query_id string, message string, body_id string, language string, history array<struct<content: string, role: string>>, description string, display_name string")
    row = answer.expert_with_graph(asked, definition, filled).first()
    assert "[source:0]" in row.result and row.sources == []


def test_tree_ingest(spark, store):
    from lorebase import fixed
    from lorebase.operators.tree import tree_documents

    spaces = spark.createDataFrame(
        [("b-knowledge", None, 0, "s1", "Top", "All of it", None, None), ("b-knowledge", "s1", 1, "s2", "Sub", "<p>Part</p>", "https://x/2", None)],
        "collection string, parent_id string, pos int, id string, name string, description string, url string, top_type string")
    callouts = spark.createDataFrame([("b-knowledge", "s1", 0, "c1", "Call", "Talk here", None)],
                                     "collection string, space_id string, pos int, id string, name string, description string, url string")
    contributions = spark.createDataFrame([("b-knowledge", "c1", 0, "post", "p1", "Post", "Body", None, None)],
                                          "collection string, callout_id string, pos int, kind string, id string, name string, body string, uri string, url string")
    numbered = ingest.numbered_tree_documents(tree_documents(spaces, callouts, contributions))
    assert [r.document_id for r in numbered.orderBy("position").collect()] == ["s1", "c1", "p1", "s2"]
    outcome = ingest.ingest(store, numbered, size=fixed.TREE_CHUNK[0], overlap=fixed.TREE_CHUNK[1])
    assert outcome.results.first().success and outcome.results.first().chunks_stored == 5  # four chunks and the overview
    assert store.get("b-knowledge", where={"documentId": "s2"}).first().metadata.uri == "https://x/2"
    overview = store.get("b-knowledge", where={"documentId": fixed.OVERVIEW_DOC_ID}).first()
    assert overview.document.startswith("Top\n\nAll of it") and overview.metadata.type == fixed.OVERVIEW_TYPE


# -- deltas, compaction, ledger, pushdown ----------------------------------------------------------


def numbered(spark, n, collection="a", text="text"):
    vector = F.array(*[F.rand(i).cast("float") for i in range(16)])
    meta = F.struct(
        F.concat(F.lit("d"), F.format_string("%05d", (F.col("id") / 10).cast("int"))).alias("documentId"), F.lit("s").alias("source"), F.lit("knowledge").alias("type"),
        F.lit("t").alias("title"), F.lit("chunk").alias("embeddingType"), (F.col("id") % 10).cast("int").alias("chunkIndex"), F.lit(None).cast("string").alias("uri"))
    rows = spark.range(n).select(F.lit(collection).alias("collection"), F.sha2(F.col("id").cast("string"), 256).alias("id"),
                                 F.concat(F.lit(text), F.sha2(F.concat(F.lit(text), F.col("id").cast("string")), 512)).alias("document"), meta.alias("metadata"), vector.alias("embedding"))
    return rows.to(ROW)


def written_bytes(store, after):
    return {e["path"]: e["bytes"] for e in store._manifest()["entries"] if e["path"] not in after}


def test_one_document_writes_less_than_a_hundredth(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(numbered(spark, 40_000))
    whole = written_bytes(store, {})
    store.upsert(numbered(spark, 3, text="new"))
    added = written_bytes(store, whole)
    assert added and sum(added.values()) < sum(whole.values()) / 100
    assert store.read().count() == 40_000 and store.get("a", where={"documentId": "d00000"}).filter("document like 'new%'").count() == 3
    held = written_bytes(store, {})
    store.delete_documents(spark.createDataFrame([("a", "d00007")], "collection string, document_id string"))
    assert sum(written_bytes(store, held).values()) < sum(whole.values()) / 100
    assert store.read().count() == 39_990 and not store.exists("a", "d00007") and store.exists("a", "d00008")


def test_compaction_keeps_rows_and_splits_large_buckets(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "s"), buckets=2, bucket_bytes=60_000, most_deltas=2)
    expected = {}
    for step, n in enumerate((600, 900, 50, 700)):
        rows = numbered(spark, n, text=f"v{step}-")
        store.upsert(rows)
        expected |= {r.id: r.document for r in rows.collect()}
        if step == 2:
            gone = spark.createDataFrame([("a", i) for i in sorted(expected)[::7]] + [("a", "none"), ("zz", "1")], "collection string, id string")
            store.delete_ids(gone)
            expected = {k: v for k, v in expected.items() if k not in set(sorted(expected)[::7])}
    state = lambda version=None: {r.id: r.document for r in store.read(version=version).collect()}
    assert state() == expected
    before = store.version()
    store.compact()
    assert state() == expected and state(before) == expected
    entries = store._manifest()["entries"]
    assert not any(e["delta"] for e in entries) and max(e["depth"] for e in entries) > 1
    one = sorted(expected)[5]
    assert [r.document for r in store.get("a", ids=[one]).collect()] == [expected[one]]
    store.upsert(numbered(spark, 3, text="later"))  # deltas after a split
    expected |= {r.id: r.document for r in numbered(spark, 3, text="later").collect()}
    assert state() == expected
    untouched = {p for p, e in ((e["path"], e) for e in store._manifest()["entries"]) if not e["delta"]}
    store.compact(every=True)
    assert state() == expected
    now = {e["path"] for e in store._manifest()["entries"]}
    assert len(untouched - now) <= 3  # only the buckets of those three rows are rewritten
    assert store.vacuum(keep=1) > 0 and state() == expected and store.vacuum(keep=1) == 0


def test_emptied_buckets_take_rows_again(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "s"), buckets=4, bucket_bytes=4_000)
    rows = numbered(spark, 60)
    store.upsert(rows)
    store.compact()
    store.delete_where("a", source="s")
    store.compact(every=True)
    assert store.read().isEmpty()
    store.upsert(rows)
    store.upsert(numbered(spark, 5, text="x"))
    store.compact(every=True)
    assert store.read().count() == 60 and store.read().filter("document like 'x%'").count() == 5


def test_batches_are_taken_once(spark, store):
    first, second = rows_of(spark, [("a", "1", "one", "d1", "chunk", [1])]), rows_of(spark, [("a", "1", "two", "d1", "chunk", [1])])
    assert store.upsert(first, batch=("events", 0)) == 1
    assert store.upsert(second, batch=("events", 0)) == 1  # replayed: refused
    assert [r.document for r in store.read().collect()] == ["one"]
    store.upsert(second, batch=("other", 0))
    store.upsert(first.limit(0), batch=("events", 1))  # an empty batch is a batch
    assert store._manifest()["batches"] == {"events": 1, "other": 0}


def test_a_stream_that_dies_between_writing_and_publishing(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "s")
    rows_of(spark, [("a", "1", "one", "d1", "chunk", [1]), ("a", "2", "two", "d2", "chunk", [1])]).write.parquet(source)
    calls = []

    class Dying(KnowledgeStore):
        def _publish(self, version, manifest):
            if len(calls) == 1:
                raise OSError("lost")
            super()._publish(version, manifest)

    def run(store, after):
        def take(batch, number):
            calls.append(number)
            store.upsert(batch, batch=("events", number))
            if after:
                raise OSError("lost after the commit")

        query = spark.readStream.schema(ROW).parquet(source).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(Dying(spark, root), False)
    assert KnowledgeStore(spark, root).version() == 0  # written, not published
    with pytest.raises(Exception, match="lost"):
        run(KnowledgeStore(spark, root), True)
    assert KnowledgeStore(spark, root).version() == 1  # published, not acknowledged
    run(KnowledgeStore(spark, root), False)
    assert calls == [0, 0, 0]  # the same batch three times, stored once
    store = KnowledgeStore(spark, root)
    assert store.version() == 1 and ids(store.read()) == ["1", "2"]


def scanned_rows(df):
    """Rows that the Parquet scans returned, row groups skipped by statistics and Bloom filters left out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())

    walk(plan)
    return sum(found)


def test_lookups_skip_row_groups(spark, tmp_path):
    store = KnowledgeStore(spark, str(tmp_path / "s"), buckets=1, row_group_bytes=64_000)
    store.upsert(numbered(spark, 20_000))
    by_document = store.get("a", where={"documentId": "d00500"}, include=["metadata"])
    assert 10 <= scanned_rows(by_document) < 6_000 and by_document.count() == 10
    one = store.read().orderBy("id").first().id
    by_id = store.get("a", ids=[one], include=["metadata"])
    assert 1 <= scanned_rows(by_id) < 12_000 and by_id.count() == 1
    assert scanned_rows(store.get("a", where={"documentId": "missing"}, include=[])) < 6_000
