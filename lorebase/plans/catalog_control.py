"""Events, messages, model answers, numbers, evaluation and test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions import answers, events, messages
from lorebase.functions.models import ModelPorts
from lorebase.functions.text import ordered_lines, render
from lorebase.operators import evaluation
from lorebase.operators.retrieval import contexts
from lorebase.operators.summaries import map_budget
from lorebase.plans.catalog_retrieval import GUIDANCE_BUDGET, RETRIEVE_GUIDANCE_FIT, guidance
from lorebase.plans.corpus import EARLIER_SQL, chunks_sql, conversation_questions, earlier_documents, hashed_chunks
from lorebase.plans.graph import PromptGraph, format_instructions
from lorebase.sources.tables import table
from lorebase.sources.testsets import checked_lines

# -- messages -------------------------------------------------------------------------


def history_text(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of every conversation as condensation input and as graph input."""
    turns = table(spark, folder, "conversations")
    role = messages.speaker(F.col("role"))
    return turns.groupBy("conv_id").agg(
        ordered_lines(F.col("turn"), messages.history_line(F.col("role"), F.col("text")), "\n").alias("history"),
        ordered_lines(F.col("turn"), messages.turn_block(role, F.col("text")), "\n").alias("conversation"),
    )


_SPEAKER = "CASE WHEN role = 'system' THEN 'system' WHEN role IN ('assistant', 'ai') THEN 'ai' ELSE 'human' END"
HISTORY_TEXT_SQL = f"""
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history,
       string_agg({_SPEAKER} || ':' || chr(10) || text, chr(10) ORDER BY turn) AS conversation
FROM conversations GROUP BY conv_id"""


def messages_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a chat message, mapped as an array per turn."""
    turns = table(spark, folder, "conversations")
    one = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    return turns.select("conv_id", "turn", F.explode(messages.chat_messages(one)).alias("m")).select(
        "conv_id", "turn", F.col("m.role").alias("role"), F.length("m.content").cast("long").alias("n_chars")
    )


MESSAGES_ROLES_SQL = f"SELECT conv_id, turn, {_SPEAKER} AS role, length(text) AS n_chars FROM conversations"


def messages_assembled(spark: SparkSession, folder: str) -> DataFrame:
    """System prompts of a conversation, then its question as the human turn."""
    turns = table(spark, folder, "conversations")
    prompts = turns.filter(F.col("role") == "system").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]).alias("prompts")
    )
    asked = conversation_questions(spark, folder).select(F.col("query_id").cast("long").alias("conv_id"), "question")
    built = asked.join(prompts, "conv_id", "left").select("conv_id", F.posexplode(messages.assembled(F.col("prompts"), F.col("question"))).alias("pos", "m"))
    return built.select("conv_id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


MESSAGES_ASSEMBLED_SQL = """
WITH q AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations
      WHERE role = 'system' AND conv_id IN (SELECT conv_id FROM q)),
n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY 1)
SELECT conv_id, CAST(pos AS INTEGER) AS pos, 'system' AS role, text AS content FROM s
UNION ALL
SELECT conv_id, CAST(coalesce(n, 0) AS INTEGER), 'human', question FROM q LEFT JOIN n USING (conv_id)"""


def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    """The condensation prompt of every conversation."""
    history = history_text(spark, folder).select("conv_id", "history")
    asked = conversation_questions(spark, folder).select(F.col("query_id").cast("long").alias("conv_id"), "question")
    return asked.join(history, "conv_id").select(
        "conv_id", render(fixed.GUIDANCE_CONDENSE_PROMPT, chat_history=F.col("history"), question=F.col("question")).alias("prompt")
    )


def _template_sql(template: str, **columns: str) -> str:
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, column in columns.items():
        text = text.replace("{" + name + "}", f"' || {column} || '")
    return text


PROMPT_RENDER_SQL = f"""
WITH h AS ({HISTORY_TEXT_SQL}), q AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, {_template_sql(fixed.GUIDANCE_CONDENSE_PROMPT, chat_history='history', question='question')} AS prompt
FROM q JOIN h USING (conv_id)"""


def query_instruction(spark: SparkSession, folder: str) -> DataFrame:
    """Question texts as three embedding models would get them: by name, explicit, explicit and empty."""
    turns = table(spark, folder, "conversations").filter(F.col("role") == "user")
    model = F.when(F.col("turn") == 0, "Qwen3-Embedding-8B").otherwise("text-embedding-3-small")
    none, text = F.lit(None).cast("string"), F.col("text")
    return turns.select(
        "conv_id", "turn", messages.query_text(model, none, text).alias("by_name"),
        messages.query_text(model, F.lit("query: "), text).alias("explicit"), messages.query_text(model, F.lit(""), text).alias("emptied"),
    )


QUERY_INSTRUCTION_SQL = f"""
SELECT conv_id, turn, CASE WHEN turn = 0 THEN {_template_sql(fixed.QWEN_INSTRUCTION)} ELSE '' END || text AS by_name,
       'query: ' || text AS explicit, text AS emptied
FROM conversations WHERE role = 'user'"""

# -- events ---------------------------------------------------------------------------


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Message bodies made of the events: questions, site ingests, incomplete and broken ones."""
    e = table(spark, folder, "events")
    user = F.col("user_id").cast("string")
    question = F.to_json(F.struct(F.struct(
        F.lit("expert").alias("engine"), user.alias("userID"), F.col("event_type").alias("message"), F.lit("p1").alias("personaID")
    ).alias("input")))
    site = F.to_json(F.struct(
        F.lit("IngestWebsite").alias("eventType"), F.concat(F.lit("https://site"), user, F.lit(".example")).alias("baseUrl"),
        F.lit("website").alias("type"), F.lit("knowledge").alias("purpose"), user.alias("personaId"),
    ))
    partial = F.to_json(F.struct(F.struct(F.lit("expert").alias("engine"), F.col("user_id").alias("userID")).alias("input")))
    body = (
        F.when(F.col("event_type").isin("click", "view"), question).when(F.col("event_type") == "signup", site)
        .when(F.col("event_type") == "purchase", partial).otherwise(F.concat(F.lit("{"), F.col("props")))
    )
    return e.select("event_id", "event_type", "props", body.alias("body"))


def event_route(spark: SparkSession, folder: str) -> DataFrame:
    routed = _bodies(spark, folder).select(
        "event_id", events.route(F.col("body"), F.lit("expert")).alias("kind"),
        events.route(F.col("body"), F.lit("ingest-space")).alias("kind_at_tree_worker"),
    )
    return routed.select("event_id", "kind", events.is_ingest(F.col("kind")).alias("early_ack"), "kind_at_tree_worker")


EVENT_ROUTE_SQL = """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'query' WHEN event_type = 'signup' THEN 'website-ingest' ELSE 'error' END AS kind,
       event_type = 'signup' AS early_ack, 'error' AS kind_at_tree_worker
FROM events"""


def retry_or_reject(spark: SparkSession, folder: str) -> DataFrame:
    """Decision for every failed message; the payload's counter is the retry header."""
    bodies = _bodies(spark, folder)
    retries = (F.get_json_object("props", "$.k").cast("int") % 4).cast("int")
    parsed = events.route(F.col("body"), F.lit("expert")) != events.ERROR
    return bodies.select("event_id", retries.alias("retry_count"), events.failed_delivery(retries, parsed).alias("decision"))


RETRY_SQL = """
SELECT event_id, CAST(CAST(props->>'$.k' AS INTEGER) % 4 AS INTEGER) AS retry_count,
       CASE WHEN CAST(props->>'$.k' AS INTEGER) % 4 < 2 THEN 'retry' WHEN event_type IN ('click', 'view', 'signup') THEN 'publish_error'
            ELSE 'drop' END AS decision
FROM events"""


def envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Published JSON of every routable message; questions carry their original."""
    bodies = _bodies(spark, folder).withColumn("kind", events.route(F.col("body"), F.lit("expert"))).filter(F.col("kind") != events.ERROR)
    response = F.struct(F.concat(F.lit("answer to "), F.col("event_type")).alias("result"), F.lit("EN").alias("humanLanguage"))
    original = events.parse_query(F.col("body"))
    wrapped = bodies.select("event_id", events.envelope(response, F.col("kind"), original).alias("sent"))
    parts = {"result": "response.result", "message": "original.message", "operation": "original.operation",
             "language": "original.language", "body_id": "original.bodyOfKnowledgeID"}
    return wrapped.select("event_id", *[F.get_json_object("sent", f"$.{path}").alias(name) for name, path in parts.items()])


ENVELOPE_SQL = """
SELECT event_id, 'answer to ' || event_type AS result, CASE WHEN event_type <> 'signup' THEN event_type END AS message,
       CASE WHEN event_type <> 'signup' THEN 'query' END AS operation, CASE WHEN event_type <> 'signup' THEN 'EN' END AS language,
       CAST(NULL AS VARCHAR) AS body_id
FROM events WHERE event_type IN ('click', 'view', 'signup')"""


def numeric_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Durations, back-off delays and epoch stamps over the events."""
    minutes, seconds = evaluation.duration_parts(F.col("value"))
    attempt = F.get_json_object("props", "$.k").cast("int") % 3
    return table(spark, folder, "events").select(
        "event_id", minutes.alias("minutes"), seconds.alias("seconds"), events.backoff_seconds(attempt).alias("delay"),
        events.epoch_millis(F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).alias("timestamp"),
    )


NUMERIC_SQL = """
SELECT event_id, CAST(floor(value / 60) AS INTEGER) AS minutes, CAST(floor(value % 60) AS INTEGER) AS seconds,
       pow(2.0, CAST(props->>'$.k' AS INTEGER) % 3) AS delay, epoch_us(ts) // 1000 AS timestamp
FROM events"""


def summary_budgets(spark: SparkSession, folder: str) -> DataFrame:
    counts = hashed_chunks(earlier_documents(spark, folder)).groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return counts.select("document_id", "n_chunks", map_budget(F.col("n_chunks"), fixed.SUMMARY_CHARS).alias("budget"))


SUMMARY_BUDGETS_SQL = f"""WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')},
n AS (SELECT document_id, count(*) AS n_chunks FROM chunks GROUP BY 1)
SELECT document_id, n_chunks, CAST(CASE WHEN n_chunks = 1 THEN 10000 ELSE greatest(500, 10000 // greatest(2, n_chunks)) END AS INTEGER) AS budget FROM n"""

# -- model answers ----------------------------------------------------------------------


def json_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Turns wrapped the ways a model wraps its JSON, and read back."""
    turns = table(spark, folder, "conversations")
    bare = F.to_json(F.struct(F.col("text").alias("answer"), F.struct(F.col("turn")).alias("sources")))
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit("Sure:\n```json\n"), bare, F.lit("\n```\nDone.")))
        .when(F.col("role") == "assistant", F.concat(F.lit("Here it is: "), bare, F.lit(" - that is all.")))
        .otherwise(F.concat(F.lit("{broken "), F.col("text")))
    )
    return turns.withColumn("raw", raw).select("conv_id", "turn", answers.answer_text(F.col("raw")).alias("answer"))


JSON_ANSWER_SQL = "SELECT conv_id, turn, CASE WHEN role = 'system' THEN '{broken ' || text ELSE text END AS answer FROM conversations"

RECORD = {"properties": [
    {"name": "knowledge_answer", "type": "string"}, {"name": "answer_language", "type": "string"},
    {"name": "source_scores", "type": "object"}, {"name": "confidence", "type": "integer"}, {"name": "note", "type": "string", "optional": True},
]}


def recover_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields recovered from nested, renamed and incomplete answers."""
    turns = table(spark, folder, "conversations")
    nested = F.to_json(F.struct(F.struct(F.col("text").alias("knowledge_answer_text"), F.struct(F.col("turn").alias("0")).alias("source_scores")).alias("result")))
    unknown = F.to_json(F.struct(F.col("text").alias("unrelated")))
    raw = F.when(F.col("role") == "system", unknown).otherwise(F.concat(F.lit("I think: "), nested))
    record = answers.structured(RECORD, strict_first=False)(F.col("raw"))
    return turns.withColumn("raw", raw).withColumn("record", record).select(
        "conv_id", "turn", F.get_json_object("record", "$.knowledge_answer").alias("answer"),
        F.get_json_object("record", "$.answer_language").alias("language"),
        F.get_json_object("record", "$.source_scores.0").cast("long").alias("score"),
        F.get_json_object("record", "$.confidence").cast("int").alias("confidence"),
        F.get_json_object("record", "$.note").alias("note"),
    )


RECOVER_SQL = """
SELECT conv_id, turn, CASE WHEN role <> 'system' THEN text END AS answer, CASE WHEN role <> 'system' THEN '' END AS language,
       CASE WHEN role <> 'system' THEN turn END AS score, CAST(CASE WHEN role <> 'system' THEN 0 END AS INTEGER) AS confidence,
       CAST(NULL AS VARCHAR) AS note
FROM conversations"""

GRAPH = {
    "nodes": [
        {"name": "check_input", "input_variables": ["conversation", "current_question"],
         "prompt": "Conversation: {conversation}\nLatest: {current_question}\n{format_instructions}",
         "output": {"properties": [{"name": "answer", "type": "string"}]}},
        {"name": "retrieve"},
        {"name": "answer_question", "input_variables": ["current_question", "combined_knowledge_docs"],
         "prompt": "Question: {current_question}\nKnowledge: {combined_knowledge_docs}"},
    ],
    "edges": [{"from": "START", "to": "check_input"}, {"from": "check_input", "to": "retrieve"},
              {"from": "retrieve", "to": "answer_question"}, {"from": "answer_question", "to": "END"}],
    "state": {"properties": [
        {"name": "conversation", "type": "string"}, {"name": "current_question", "type": "string"},
        {"name": "answer", "type": "string"}, {"name": "combined_knowledge_docs", "type": "string", "optional": True},
        {"name": "result", "type": "string", "optional": True},
    ]},
}


def prompt_graph(spark: SparkSession, folder: str) -> DataFrame:
    """A three-node graph over all conversations; the special node retrieves every question's context."""
    states = history_text(spark, folder).select("conv_id", "conversation").join(
        conversation_questions(spark, folder).select(F.col("query_id").cast("long").alias("conv_id"), F.col("question").alias("current_question")), "conv_id"
    )

    def retrieve(state: DataFrame) -> DataFrame:
        found = contexts(guidance(spark, folder), "\n").withColumn("conv_id", F.col("query_id").cast("long")).drop("query_id")
        joined = state.drop("combined_knowledge_docs").join(found, "conv_id", "left")
        return joined.withColumn("combined_knowledge_docs", F.coalesce("context", F.lit(""))).drop("context")

    graph = PromptGraph.from_definition(GRAPH).compile(ModelPorts().answer, {"retrieve": retrieve})
    return graph.run(graph.initial(states)).select("conv_id", "answer", "result", F.length("combined_knowledge_docs").alias("knowledge_chars"))


_INSTRUCTIONS = format_instructions(answers.standard_schema(GRAPH["nodes"][0]["output"])).replace("'", "''")
PROMPT_GRAPH_SQL = f"""
{RETRIEVE_GUIDANCE_FIT},
history AS ({HISTORY_TEXT_SQL}),
known AS (
  SELECT query_id, string_agg('[source:' || position || '] ' || document, chr(10) ORDER BY position) AS context
  FROM fit WHERE upto <= {GUIDANCE_BUDGET} GROUP BY query_id)
SELECT conv_id, 'Conversation: ' || conversation || chr(10) || 'Latest: ' || question || chr(10) || '{_INSTRUCTIONS}' AS answer,
       '{{"answer": ' || CAST(to_json('Question: ' || question || chr(10) || 'Knowledge: ' || coalesce(context, '')) AS VARCHAR) || '}}' AS result,
       CAST(length(coalesce(context, '')) AS INTEGER) AS knowledge_chars
FROM history JOIN questions q ON q.query_id = conv_id LEFT JOIN known ON known.query_id = conv_id"""


# -- evaluation -------------------------------------------------------------------------


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scored cases: the event type is the metric, even users the baseline run, odd ones the current."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(
        F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("current").alias("run"), F.col("event_type").alias("metric"),
        evaluation.finite(F.try_divide(F.col("value"), k)).alias("score"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def eval_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.aggregate(_scores(spark, folder), ["run"]), "mean", "median", "min", "max")


_SCORES_SQL = """
WITH s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'current' END AS run, event_type AS metric,
                  coalesce(value / nullif(CAST(props->>'$.k' AS DOUBLE), 0), 0.0) AS score FROM events),
a AS (SELECT run, metric, avg(score) AS mean, median(score) AS median, min(score) AS min, max(score) AS max, count(*) AS n_scored FROM s GROUP BY ALL),
d AS (SELECT b.metric, b.mean AS baseline, c.mean AS current, c.mean - b.mean AS absolute_delta,
             CASE WHEN b.mean = 0 THEN 0.0 ELSE (c.mean - b.mean) / b.mean * 100 END AS percentage_change
      FROM a b JOIN a c USING (metric) WHERE b.run = 'baseline' AND c.run = 'current')"""
EVAL_AGGREGATE_SQL = f"""{_SCORES_SQL}
SELECT run, metric, round(mean, 6) AS mean, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, n_scored FROM a"""


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    means = _scores(spark, folder).groupBy("run", "metric").agg(F.avg("score").alias("mean"))
    return evaluation.compare(means.filter("run = 'baseline'"), means.filter("run = 'current'"))


def eval_compare(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_deltas(spark, folder), "baseline", "current", "absolute_delta", "percentage_change")


EVAL_COMPARE_SQL = f"""{_SCORES_SQL}
SELECT metric, round(baseline, 6) AS baseline, round(current, 6) AS current, round(absolute_delta, 6) AS absolute_delta,
       round(percentage_change, 6) AS percentage_change FROM d"""


def eval_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.verdict(_deltas(spark, folder))


EVAL_VERDICT_SQL = f"""{_SCORES_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE absolute_delta > 0) AS improved, count(*) FILTER (WHERE absolute_delta < 0) AS regressed FROM d"""


def eval_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "events").select("user_id", F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return evaluation.outcome_counts(cases, ["user_id"])


EVAL_OUTCOMES_SQL = """
SELECT user_id, count(*) AS cases, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed
FROM events GROUP BY 1"""


def eval_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    """Wide scores of the labelled documents to one row per metric; missing scores are left out."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    q, t, one = F.col("quality").cast("double"), F.col("toxic").cast("double"), F.lit(1.0)
    cases = docs.select("doc_id", q.alias("faithfulness"), (one - t).alias("answer_relevancy"),
                        (one / F.col("n_chars")).alias("context_precision"), (q - t).alias("context_recall"))
    return _rounded(evaluation.long_scores(cases, ["doc_id"]), "score")


EVAL_UNPIVOT_SQL = """
WITH c AS (SELECT doc_id, CAST(quality AS DOUBLE) AS q, CAST(toxic AS DOUBLE) AS t, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
u AS (
  SELECT doc_id, 'faithfulness' AS metric, q AS score FROM c UNION ALL SELECT doc_id, 'answer_relevancy', 1 - t FROM c
  UNION ALL SELECT doc_id, 'context_precision', 1.0 / n_chars FROM c UNION ALL SELECT doc_id, 'context_recall', q - t FROM c)
SELECT doc_id, metric, round(CAST(score AS DOUBLE), 6) AS score FROM u WHERE score IS NOT NULL"""


def jsonl_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as test-set lines: users give cases, assistants incomplete ones, systems no JSON."""
    turns = table(spark, folder, "conversations")

    def case(answer: str) -> Column:
        return F.to_json(F.struct(
            F.col("text").alias("question"), F.lit(answer).alias("expected_answer"), F.array(F.col("conv_id").cast("string")).alias("relevant_documents")
        ))

    line = F.when(F.col("role") == "user", case("yes")).when(F.col("role") == "assistant", case("")).otherwise(F.col("text"))
    lines = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("line_no"), line.alias("line"))
    return checked_lines(lines).select("line_no", "issue")


JSONL_SQL = """
WITH t AS (SELECT conv_id * 1000000 + turn AS line_no, role, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS n FROM conversations)
SELECT line_no, CASE WHEN role = 'system' THEN 'invalid JSON' WHEN role = 'assistant' THEN 'validation error' WHEN n > 1 THEN 'duplicate question' END AS issue
FROM t"""

QUERIES = {
    "history_text": (history_text, HISTORY_TEXT_SQL),
    "messages_roles": (messages_roles, MESSAGES_ROLES_SQL),
    "messages_assembled": (messages_assembled, MESSAGES_ASSEMBLED_SQL),
    "prompt_render": (prompt_render, PROMPT_RENDER_SQL),
    "query_instruction": (query_instruction, QUERY_INSTRUCTION_SQL),
    "event_route": (event_route, EVENT_ROUTE_SQL),
    "retry_or_reject": (retry_or_reject, RETRY_SQL),
    "envelope": (envelope, ENVELOPE_SQL),
    "numeric_rules": (numeric_rules, NUMERIC_SQL),
    "summary_budgets": (summary_budgets, SUMMARY_BUDGETS_SQL),
    "json_answer": (json_answer, JSON_ANSWER_SQL),
    "recover_fields": (recover_fields, RECOVER_SQL),
    "prompt_graph": (prompt_graph, PROMPT_GRAPH_SQL),
    "eval_aggregate": (eval_aggregate, EVAL_AGGREGATE_SQL),
    "eval_compare": (eval_compare, EVAL_COMPARE_SQL),
    "eval_verdict": (eval_verdict, EVAL_VERDICT_SQL),
    "eval_outcomes": (eval_outcomes, EVAL_OUTCOMES_SQL),
    "eval_unpivot": (eval_unpivot, EVAL_UNPIVOT_SQL),
    "jsonl_validate": (jsonl_validate, JSONL_SQL),
}
