from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lorebase.functions import answers, events, formats, messages
from lorebase.functions.models import with_retries
from lorebase.functions.text import render
from lorebase.operators.tree import read_answers, space_paths, tree_documents
from lorebase.plans import evaluate
from lorebase.plans.graph import PromptGraph
from lorebase.plans.registry import Registry, run_stages
from lorebase.sources import graphql, links, queue, testsets
from lorebase.streaming import delivery

QUESTION = {"input": {"engine": "expert", "userID": "u", "message": "hello", "personaID": "p"}}
SITE = {"eventType": "IngestWebsite", "baseUrl": "https://a.com", "type": "website", "purpose": "knowledge", "personaId": "p"}
TREE = {"bodyOfKnowledgeId": "b", "type": "platform-space", "purpose": "knowledge", "personaId": "p"}


def routed(spark, body, worker="expert"):
    text = body if isinstance(body, str) else json.dumps(body)
    return spark.createDataFrame([(text,)], "b string").select(events.route(F.col("b"), F.lit(worker)).alias("k")).first().k


@pytest.mark.parametrize("body,worker,want", [
    (QUESTION, "expert", "query"), (SITE, "ingest-website", "website-ingest"), (TREE, "ingest-space", "tree-ingest"),
    (QUESTION, "ingest-space", "error"), ({**SITE, "baseUrl": 5}, "x", "error"), ({"input": None}, "x", "error"), ({}, "x", "error"),
    ("no json", "x", "error"), ({"input": {"engine": "e", "user_id": "u", "message": "m"}}, "x", "query"), ({"input": {"engine": "e"}}, "x", "error"),
    ({**TREE, "eventType": "IngestWebsite"}, "ingest-space", "tree-ingest"),
])
def test_routes(spark, body, worker, want):
    assert routed(spark, body, worker) == want


def test_question_defaults_and_envelope(spark):
    df = spark.createDataFrame([(json.dumps(QUESTION),)], "body string")
    e = df.select(events.parse_query(F.col("body")).alias("e")).first().e
    assert (e.operation, e.language, e.displayName, e.userID, e.bodyOfKnowledgeID) == ("query", "EN", "", "u", None)
    wrapped = df.select(events.envelope(F.struct(F.lit("x").alias("result")), F.lit("query"), events.parse_query(F.col("body"))).alias("j"),
                        events.envelope(F.struct(F.lit("x").alias("result")), F.lit("tree-ingest"), events.parse_query(F.col("body"))).alias("i")).first()
    assert json.loads(wrapped.j)["original"]["userID"] == "u" and list(json.loads(wrapped.i)) == ["response"]


@pytest.mark.parametrize("retries,parsed,want", [(0, True, "retry"), (1, False, "retry"), (2, True, "publish_error"), (2, False, "drop"), (7, True, "publish_error")])
def test_retry_rule(spark, retries, parsed, want):
    assert spark.range(1).select(events.failed_delivery(F.lit(retries), F.lit(parsed)).alias("d")).first().d == want


def test_roles(spark):
    df = spark.createDataFrame([("system",), ("assistant",), ("ai",), ("human",), ("tool",), (None,)], "r string")
    assert [r.x for r in df.select(messages.speaker(F.col("r")).alias("x")).collect()] == ["system", "ai", "ai", "human", "human", "human"]


# -- model answers ---------------------------------------------------------------------------


@pytest.mark.parametrize("text,want", [
    ('```json\n{"answer": "x"}\n```', {"answer": "x"}), ('```\n{"a": 1}\n```', {"a": 1}), ('{"a": {"b": 2}}', {"a": {"b": 2}}),
    ('Sure: {"a": 1} bye', {"a": 1}), ('{"a": 1', None), ("no json", None), ("", None), ("   ", None), ('{bad} {"a": 1}', None),
    ('```json\nbroken\n```\n{"a": 3}', {"a": 3}), ('{"a": "}"}', None),
])
def test_answer_json(text, want):
    got = answers.answer_json(text)
    assert (json.loads(got) if got else None) == want


RECORD = answers.standard_schema({"properties": [
    {"name": "answer", "type": "string"}, {"name": "tags", "type": "array", "items": {"type": "string"}}, {"name": "scores", "type": "object"},
    {"name": "sure", "type": "boolean"}, {"name": "n", "type": "integer"}, {"name": "note", "type": "string", "optional": True},
]})
EMPTY = {"tags": [], "scores": {}, "sure": False, "n": 0, "note": None}


@pytest.mark.parametrize("text,want", [
    ('{"result": {"answer": "hi"}}', {"answer": "hi", **EMPTY}), ('{"answer_text": "hi"}', {"answer": "hi", **EMPTY}),
    ('{"answer": null, "x": [{"answer": "found"}]}', {"answer": "found", **EMPTY}), ('{"other": 1}', None), ("none", None),
    ('{"answer": "a", "answer_text": "b"}', {"answer": "a", **EMPTY}), ('{"answer": 5}', None), ('x {"n": 7} y', {"answer": "", **EMPTY, "n": 7}),
])
def test_recovery(text, want):
    assert answers.recover_record(text, RECORD) == want


def test_schema_dialect_leaves_the_input_alone():
    given = {"properties": [{"name": "a", "type": "string"}, {"name": "b", "type": ["integer"], "optional": True},
                            {"name": "c", "type": "array", "items": {"properties": [{"name": "x", "type": "number"}]}}, {"type": "no name"}],
             "anyOf": [{"properties": [{"name": "z"}]}]}
    before = json.dumps(given)
    out = answers.standard_schema(given)
    assert json.dumps(given) == before
    assert out["type"] == "object" and out["required"] == ["a", "c"]
    assert out["properties"]["b"] == {"type": ["integer", "null"], "default": None}
    assert out["properties"]["c"]["items"]["required"] == ["x"] and out["anyOf"][0]["required"] == ["z"]
    assert answers.standard_schema(None) is None
    assert answers.state_type(given).simpleString() == "struct<a:string,b:bigint,c:array<struct<x:double>>>"


# -- graphs --------------------------------------------------------------------------------------

DEFINITION = {
    "nodes": [{"name": "analyze", "input_variables": ["question", "tags"], "prompt": "A {question} {tags}", "output": {"properties": [{"name": "analysis", "type": "string"}, {"name": "score", "type": "integer"}]}},
              {"name": "answer", "input_variables": ["analysis", "missing"], "prompt": "B {analysis}{missing}"}, {"name": "unused", "prompt": "never"}],
    "edges": [{"from": "START", "to": "analyze"}, {"from": "analyze", "to": "answer"}, {"from": "answer", "to": "END"}],
    "state": {"properties": {"question": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "analysis": {"type": "string"}}},
}


def model(prompt):
    return F.when(prompt.startswith("A "), F.concat(F.lit('note: {"inner": {"analysis": "'), F.regexp_replace(prompt.substr(3, 1), "\n", ","), F.lit('"}}'))).otherwise(F.concat(F.lit("got "), prompt))


def test_graph_runs_in_order_and_recovers(spark):
    graph = PromptGraph.from_definition(DEFINITION)
    assert graph.order() == ["analyze", "answer"]
    states = graph.initial(spark.createDataFrame([("why",)], "question string"))
    row = graph.compile(model).run(states).first()
    assert (row.analysis, row.score, row.result, row.tags) == ("w", 0, "got B w", [])
    assert [name for name, _ in graph.updates(states)] == ["analyze", "answer"]
    with pytest.raises(Exception, match="no structured answer"):
        PromptGraph.from_definition(DEFINITION).compile(lambda p: F.lit("nothing")).run(states).collect()


def test_graph_special_nodes_and_misuse(spark):
    graph = PromptGraph.from_definition(DEFINITION)
    with pytest.raises(RuntimeError, match="not compiled"):
        graph.run(None)
    with pytest.raises(ValueError):
        PromptGraph([], [], None).compile(model)
    special = {"analyze": lambda df: df.withColumn("analysis", F.lit("by hand"))}
    states = graph.initial(spark.createDataFrame([("why",)], "question string"))
    assert graph.compile(model, special).run(states).first().result == "got B by hand"
    loop = {**DEFINITION, "edges": DEFINITION["edges"] + [{"from": "answer", "to": "analyze"}]}
    with pytest.raises(ValueError, match="cycle"):
        PromptGraph.from_definition(loop).order()


# -- linked files ------------------------------------------------------------------------------------

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


DOCX = zipped(**{"word__document_dot_xml": f'<w:document xmlns:w="{W}"><w:body>{p("One")}{p("")}{p("Two")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr><w:tr><w:tc>{p("")}</w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = zipped(**{
    "xl__workbook_dot_xml": f'<workbook xmlns="{S}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl___rels__workbook_dot_xml_dot_rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl__sharedStrings_dot_xml": f'<sst xmlns="{S}"><si><t>name</t></si></sst>',
    "xl__worksheets__sheet1_dot_xml": f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"/></row><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
})
BODIES = [
    (b"plain   text\n\n\n\nmore", "text/plain; charset=utf-8", "text", "plain text\n\nmore"),
    (b"<html><script>x</script><p>Hi</p></html>", "", "html", "Hi"), (b"<!DOCTYPE html><p>Yo</p>", "application/octet-stream", "html", "Yo"),
    (DOCX, "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx", "One\nTwo\na | b"),
    (DOCX, "", "docx_or_xlsx", "One\nTwo\na | b"), (XLSX, "", "docx_or_xlsx", "## Data\nname | | 3\n | x"),
    (b'{"a": 1}', "application/json", "text", '{"a": 1}'), (b"\x00\x01", "image/png", None, None), (b"%PDF-1.4 broken", "", "pdf", None),
    (b"not a zip", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx", None), (b"", "text/plain", "text", None), (b"   ", "text/plain", "text", None),
]


def test_linked_text(spark):
    df = spark.createDataFrame([(i, bytearray(b), t) for i, (b, t, _, _) in enumerate(BODIES)], "i int, body binary, t string")
    got = df.select("i", formats.kind_of(F.col("body"), F.col("t")).alias("k"), formats.linked_text(F.col("body"), F.col("t")).alias("x")).orderBy("i").collect()
    assert [(r.k, r.x) for r in got] == [(k, x) for _, _, k, x in BODIES]


def test_files_by_extension_and_cap(spark, tmp_path):
    assert formats.file_text(DOCX, "a.DOCX") == "One\n\nTwo" and formats.file_text(XLSX, "b.xlsx") == "name | 3\nx"
    assert formats.file_text(b"x", "a.txt") is None and formats.file_text(b"x", "docx") is None and formats.file_text(b"x", "a.docx") is None
    for name, body in (("small.html", b"<html><p>Hi</p></html>"), ("large.html", b"<html>" + b"x" * 500)):
        (tmp_path / name).write_bytes(body)
    found = links.fetched_texts(links.read_bodies(spark, str(tmp_path), max_bytes=100)).collect()
    assert [(os.path.basename(r.uri), r.fetched_text) for r in found] == [("small.html", "Hi")]


# -- trees -----------------------------------------------------------------------------------------


def profile(name, description=None, url=None):
    return {"displayName": name, "description": description, "url": url}


def callout(i, name, description, *contributions):
    return {"id": i, "framing": {"profile": profile(name, description)}, "contributions": list(contributions)}


def space(i, name, description, callouts=(), subspaces=()):
    return {"id": i, "profile": profile(name, description, f"https://x/{i}"), "collaboration": {"calloutsSet": {"callouts": list(callouts)}}, "subspaces": list(subspaces)}


POST = {"post": {"id": "p1", "profile": profile("Post", "<p>Post body</p>", "https://x/p1")}}
BOARD = {"whiteboard": {"id": "w1", "profile": profile("Board", None, "https://x/w1"), "content": "drawn"}}
LINK = {"link": {"id": "l1", "profile": profile("Link", "About"), "uri": "https://ext/doc"}}
BARE = {"link": {"id": "l2", "profile": profile("Bare"), "uri": "https://ext/none"}}
REPEAT = {"post": {"id": "p2", "profile": profile("Post", "post   BODY")}}


def flattened(spark, body, kind="platform-space", fetched=None, flat_type="platform-knowledge-base"):
    df = spark.createDataFrame([("c", kind, json.dumps(body))], "collection string, bok_type string, body string")
    links_ = spark.createDataFrame(fetched, "uri string, fetched_text string") if fetched else None
    return tree_documents(*read_answers(df, flat_type), fetched=links_).orderBy("path").collect()


def test_tree_in_pre_order_with_context(spark):
    deep = space("s3", "Deep", "level three")
    top = space("s1", "Top", "All &amp; more", [callout("c1", "Call", "<b>" + "d" * 500 + "</b>", POST, BOARD, LINK, BARE, REPEAT)], [space("s2", "Sub", "level two", (), [deep])])
    got = flattened(spark, {"lookup": {"space": top}}, fetched=[("https://ext/doc", "Full body")])
    assert [(r.source, r.type) for r in got] == [
        ("space:s1", "space"), ("callout:c1", "callout"), ("post:p1", "post"), ("whiteboard:w1", "whiteboard"), ("link:l1", "link"), ("link:l2", "link"),
        ("space:s2", "subspace"), ("space:s3", "subspace"),
    ]
    context = "Call\n\n" + "d" * 400
    assert got[0].content == "Top\n\nAll & more" and got[0].uri == "https://x/s1"
    assert got[2].content == f"{context}\n\n# Post\n\nPost body" and got[2].uri == "https://x/p1"
    assert got[3].content == f"{context}\n\n# Board\n\ndrawn"
    assert got[4].content == "# Link\n\nAbout\n\nFull body" and got[4].uri == "https://ext/doc"
    assert got[5].content == f"{context}\n\n# Bare\n\nURL: https://ext/none"


def test_knowledge_base_is_flat(spark):
    base = {"id": "k", "profile": profile("Base", "Text"), "calloutsSet": {"callouts": [callout("c", "Call", None, POST)]}}
    got = flattened(spark, {"lookup": {"knowledgeBase": base}}, "platform-knowledge-base")
    assert [(r.source, r.type) for r in got] == [("space:k", "knowledge"), ("post:p1", "post")]
    assert got[1].content == "Call\n\n# Post\n\nPost body"
    assert flattened(spark, {"lookup": None}, "other") == []
    tree = {"lookup": {"space": space("s", "Other", "Text")}}
    assert [r.source for r in flattened(spark, tree, "another-knowledge-base")] == ["space:s"]


def test_trees_of_any_depth_and_long_positions(spark):
    chain = space("s9", "Name 9", "level 9", [callout("c", "Call", None, POST)])
    for i in range(8, -1, -1):
        chain = space(f"s{i}", f"Name {i}", f"level {i}", (), [chain])
    got = flattened(spark, {"lookup": {"space": chain}})
    assert [r.source for r in got] == [f"space:s{i}" for i in range(10)] + ["post:p1"]
    spaces = spark.createDataFrame(
        [("c", None, 0, "top"), ("c", "top", 12345678909, "b"), ("c", "top", 12345678901, "a"), ("c", "a", 0, "top")],
        "collection string, parent_id string, pos bigint, id string",
    )
    found = space_paths(spaces).orderBy("path").collect()
    assert [r.id for r in found] == ["top", "a", "b"] and len({r.path for r in found}) == 3  # the cycle ends


def test_tree_client_retries_and_raises():
    calls, pauses = [], []

    def post(address, headers, body):
        if "method" in body:
            return {"session_token": "t"}
        calls.append(headers["Authorization"])
        if len(calls) < 3:
            raise ConnectionError("down")
        return {"data": {"lookup": {}}}

    client = graphql.TreeClient("e", "l/", "m", "p", post, lambda a: {"ui": {"action": "go"}}, pauses.append)
    assert client.query("q") == {"lookup": {}} and calls == ["Bearer t"] * 3 and pauses == [1.0, 2.0]
    failing = graphql.TreeClient("e", "l", "m", "p", lambda *a: {"errors": ["no"]}, lambda a: {}, pauses.append, token="t")
    with pytest.raises(RuntimeError, match="GraphQL errors"):
        failing.query("q")
    assert "subspaces" in graphql.SPACE_QUERY and "subspaces" not in graphql.KNOWLEDGE_BASE_QUERY


def test_model_calls_do_not_retry_timeouts():
    calls = []

    def slow():
        calls.append(1)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        with_retries(slow, 3, 1.0, lambda s: None)
    assert len(calls) == 1


# -- test sets and runs -----------------------------------------------------------------------------


def lines_file(tmp_path, *lines):
    path = tmp_path / "set.jsonl"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def case(q, a="a", d=("x",)):
    return json.dumps({"question": q, "expected_answer": a, "relevant_documents": list(d)})


def test_test_set_issues(spark, tmp_path):
    path = lines_file(tmp_path, case("q1"), "", "{bad", case("q2", d=()), case("q1"), case("q3", a=""), json.dumps({"question": 5}))
    got = testsets.issue_lines(testsets.checked_lines(testsets.numbered_lines(spark, path))).orderBy("line_no").collect()
    assert [r.message for r in got] == ["Line 3: invalid JSON", "Line 4: validation error", "Line 5: duplicate question - q1", "Line 6: validation error", "Line 7: validation error"]
    with pytest.raises(ValueError):
        testsets.load_test_set(spark, path)


def test_test_set_round_trip(spark, tmp_path):
    cases = testsets.load_test_set(spark, lines_file(tmp_path, case("q1"), " ", case("q2"), case("q1")))
    assert cases.count() == 3
    assert [r.line_no for r in testsets.duplicates(cases, "line_no").collect()] == [4]
    testsets.write_test_set(cases, str(tmp_path / "out"))
    assert testsets.load_test_set(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        testsets.load_test_set(spark, lines_file(tmp_path, ""))


def test_synthetic_cases(spark):
    samples = spark.createDataFrame([(1, "q1", "ref", None, ["http://a", "text"]), (2, "q2", "", "resp", None), (3, "", "x", None, None), (4, "q4", None, None, None)],
                                    "sample_id int, user_input string, reference string, response string, reference_contexts array<string>")
    got = testsets.synthetic_cases(samples, spark.createDataFrame([(1, ""), (2, "s2"), (3, "s3")], "rank int, source string")).orderBy("question").collect()
    assert [(r.question, r.expected_answer, r.relevant_documents) for r in got] == [("q1", "ref", ["http://a"]), ("q2", "resp", ["s2"])]
    assert testsets.generator_rows(3) == 30 and testsets.generator_rows(90) == 500


def test_evaluation_run(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"q{i} " + "x" * 60, "a", ["d"]) for i in range(4)], "index int, question string, expected_answer string, relevant_documents array<string>")

    def invoke(df):
        bad = F.col("index") == 1
        return df.select("index", F.when(~bad, "answer").alias("pipeline_answer"), F.array(F.lit("ctx")).alias("retrieved_contexts"), F.when(bad, "no model").alias("invoke_error"))

    def score(df):
        value = F.col("index").cast("double") / 4
        return df.select("index", F.when(F.col("index") == 2, "no score").alias("score_error"), value.alias("faithfulness"), value.alias("answer_relevancy"),
                         F.lit(float("nan")).alias("context_precision"), F.lit(1.0).alias("context_recall"))

    run = evaluate.evaluate(cases, invoke, score, "my run!")
    assert run.id.endswith("_my-run") and tuple(run.counts.first()) == (4, 2, 2)
    got = {r["index"]: r for r in run.cases.collect()}
    assert got[1].error == "no model" and got[2].error == "no score" and got[2].pipeline_answer == "answer" and got[2].faithfulness is None
    means = {r.metric: r["mean"] for r in run.aggregate.collect()}
    assert means == {"faithfulness": 0.375, "answer_relevancy": 0.375, "context_precision": 0.0, "context_recall": 1.0}
    evaluate.write_run(run, str(tmp_path), "guidance", "my run!")
    later = evaluate.evaluate(cases.filter("index = 3"), invoke, score)
    later.id = "29990101T000000"
    evaluate.write_run(later, str(tmp_path), "expert")
    listed = evaluate.list_runs(spark, str(tmp_path)).collect()
    assert [r.id for r in listed] == ["29990101T000000", run.id] and listed[1].faithfulness == 0.375
    deltas = evaluate.compare_runs(spark, str(tmp_path), run.id, later.id)
    assert {r.metric: r.absolute_delta for r in deltas.collect()}["faithfulness"] == 0.375
    assert len(evaluate.failure_lines(run.cases).collect()) == 2
    assert evaluate.summary_lines(run.aggregate).filter("metric = 'faithfulness'").first().line.startswith("  faithfulness             0.375")
    assert "%" in evaluate.comparison_lines(deltas).first().line


def test_answer_text_keeps_a_null_answer(spark):
    raw = ['{"answer": "a"}', '{"answer": null}', '{"other": 1}', 'no json', 'x ```json\n{"answer": "b"}\n``` y', '[1]', None]
    got = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", answers.answer_text(F.col("raw")).alias("a"))
    assert [r.a for r in got.orderBy("i").collect()] == ["a", None, '{"other": 1}', "no json", "b", "[1]", None]


# -- registry ------------------------------------------------------------------------------------------


class Port:
    pass


class Other:
    pass


class Worker:
    name, event_type = "worker", "query"

    def __init__(self, port: Port, other: Other | None = None, *, extra: Other = None) -> None:
        self.port, self.extra = port, extra

    def handle(self, events):
        return events


def test_registry():
    registry = Registry()
    registry.register(Worker)
    assert registry.names() == ["worker"]
    with pytest.raises(LookupError):
        registry.build("worker")
    registry.bind(Port, "p")
    built = registry.build("worker")
    assert built.port == "p" and built.extra is None and registry.port(Port) == "p"
    with pytest.raises(ValueError):
        registry.register(Port)
    with pytest.raises(LookupError):
        registry.build("none")


def test_destructive_stage_is_gated(spark):
    def drop_all(df):
        return df.limit(0)

    drop_all.destructive, drop_all.name = True, "drop"
    df, skipped = run_stages(spark.range(3), [drop_all], lambda: ["x"])
    assert df.count() == 3 and skipped == ["drop: skipped (destructive step gated by 1 prior error(s))"]
    assert run_stages(spark.range(3), [drop_all])[0].count() == 0


def test_render_needs_every_field():
    with pytest.raises(KeyError):
        render("{a}")


# -- delivery --------------------------------------------------------------------------------------


@pytest.fixture
def routes(tmp_path):
    return delivery.Routes(*(str(tmp_path / n) for n in ("inbox", "results", "accepted", "checkpoint")))


def send(spark, routes, name, *bodies):
    data = [(f"{name}-{i}", b if isinstance(b, str) else json.dumps(b), 0, "in") for i, b in enumerate(bodies)]
    spark.createDataFrame(data, queue.MESSAGE).coalesce(1).write.json(f"{routes.inbox}/{name}")


def echo(df):
    asked = F.get_json_object("body", "$.input.message")
    return df.select("message_id", F.concat(F.lit("re: "), asked).alias("result"), F.when(asked == "fail", "Error: bad question").alias("error"))


def published(spark, folder):
    if not os.path.isdir(folder):
        return {}
    return {r.message_id: json.loads(r.body) for r in spark.read.schema("message_id string, body string").option("recursiveFileLookup", "true").json(folder).collect()}


def question(text):
    return {"input": {**QUESTION["input"], "message": text}}


def drain(spark, routes, handler=echo, **options):
    query = delivery.start(spark, routes, "expert", handler, available_now=True, files_per_batch=100, **options)
    query.awaitTermination(120)
    return query


def test_stream_answers_retries_and_reports(spark, routes):
    send(spark, routes, "m", question("one"), question("fail"), SITE, "broken")
    for _ in range(4):
        query = drain(spark, routes)
    got = published(spark, routes.results)
    assert got["m-0"]["response"]["result"] == "re: one" and got["m-0"]["original"]["message"] == "one"
    assert got["m-1"]["response"]["result"] == "Error: bad question"  # reported once, at the last attempt
    assert set(got) == {"m-0", "m-1"}  # a broken message is dropped in silence
    tries = sorted((r.message_id, r.retry_count) for r in queue.read_batch(spark, routes.inbox).collect())
    assert [t for t in tries if t[0] == "m-1"] == [("m-1", 0), ("m-1", 1), ("m-1", 2)] and len([t for t in tries if t[0] == "m-3"]) == 3
    assert set(published(spark, routes.accepted)) == {"m-2"}
    assert delivery.stop(query) and delivery.health(query)["status"] == "not_ready"


def test_early_acknowledged_work(spark, routes):
    batch = spark.createDataFrame([("s", json.dumps(SITE), 0, "in")], queue.MESSAGE)
    delivery.process_batch(batch, 0, routes, "ingest-website", echo)
    delivery.run_accepted(spark, routes, 0, lambda df: df.select("message_id", F.lit("success").alias("result"), F.lit(None).cast("string").alias("error")))
    got = published(spark, f"{routes.results}-ingest")
    assert got["s"] == {"response": {"result": "success"}}

    def broken(df):
        raise RuntimeError("no site")

    delivery.run_accepted(spark, routes, 0, broken)
    assert published(spark, f"{routes.results}-ingest")["s"]["response"]["result"] == "Error: no site"


def test_batch_equals_stream_and_replay_is_idempotent(spark, routes, tmp_path):
    bodies = [question(f"m{i}") for i in range(5)] + [SITE]
    send(spark, routes, "m", *bodies)
    drain(spark, routes)
    streamed = published(spark, routes.results)
    other = delivery.Routes(*(str(tmp_path / f"b-{n}") for n in ("inbox", "results", "accepted", "checkpoint")))
    batch = queue.read_batch(spark, routes.inbox)
    for _ in range(2):
        delivery.process_batch(batch, 0, other, "expert", echo)
    assert published(spark, other.results) == streamed and len(streamed) == 5


def test_timeout_counts_as_failure(spark, routes):
    import time

    def slow(df):
        time.sleep(3)
        return echo(df)

    batch = spark.createDataFrame([("a", json.dumps(question("x")), 2, "in"), ("b", json.dumps(question("y")), 0, "in")], queue.MESSAGE)
    delivery.process_batch(batch, 0, routes, "expert", slow, timeout=0.5)
    got = published(spark, routes.results)
    assert set(got) == {"a"} and "timed out after 0.5s" in got["a"]["response"]["result"]
    assert [(r.message_id, r.retry_count) for r in queue.read_batch(spark, routes.inbox).collect()] == [("b", 1)]


def test_contributions_without_address_stay_out_of_the_shuffle_by_address(spark):
    """Only rows with a uri meet fetched bodies, and a row's key is bytes; the texts are those of one join over all rows."""
    space = "collection string, id string, parent_id string, pos long, name string, description string, url string, top_type string"
    spaces = spark.createDataFrame([("c", "s", None, 0, "S", "space", None, None)], space)
    callouts = spark.createDataFrame([("c", "s", 0, "k", "K", "callout", None)], "collection string, space_id string, pos long, id string, name string, description string, url string")
    made = "collection string, callout_id string, pos long, kind string, id string, name string, body string, uri string, url string"
    rows = [
        ("c", "k", 0, "post", "p0", "Post", "text", None, "u"), ("c", "k", 1, "link", "p1", "Found", "body", "https://a", "u"),
        ("c", "k", 2, "link", "p2", "Lost", "body", "https://b", "u"), ("c", "k", 3, "link", "p3", "None", "body", None, "u"),
        ("c", "k", 4, "post", "p4", "Post too", "text", "https://a", "u"), ("c", "k", 5, "link", "p5", "found", "BODY", "https://a", "u"),
    ]
    fetched = spark.createDataFrame([("https://a", "whole text"), (None, "of no address")], "uri string, fetched_text string")
    docs = tree_documents(spaces, callouts, spark.createDataFrame(rows, made), fetched)
    found = {r.document_id: r.content for r in docs.collect()}
    assert found == {
        "s": "S\n\nspace", "k": "K\n\ncallout", "p0": "K\n\ncallout\n\n# Post\n\ntext", "p1": "# Found\n\nbody\n\nwhole text",
        "p2": "K\n\ncallout\n\n# Lost\n\nbody\n\nURL: https://b", "p3": "K\n\ncallout\n\n# None\n\nbody", "p4": "K\n\ncallout\n\n# Post too\n\ntext",
    }
    plan = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    below = [line for line in plan[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
    assert any("isnotnull(uri" in line for line in below) and any("unhex(sha2(" in line for line in plan)
