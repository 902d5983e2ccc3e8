"""Retrieval queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.models import hashed_embedding
from lorebase.functions.text import ordered_lines
from lorebase.operators.balls import BallIndex
from lorebase.operators.knn import nearest
from lorebase.operators.ordering import running_sum
from lorebase.operators.retrieval import (
    expert_results, first_per_source, guidance_results, numbered, with_documents,
)
from lorebase.plans.corpus import (
    EARLIER_SQL, chunks_sql, conversation_questions, earlier_documents, slots_sql, vector_store,
)
from lorebase.sources.tables import table

GUIDANCE_COLLECTIONS = ("en-knowledge", "de-knowledge", "fr-knowledge", "es-knowledge")
GUIDANCE_BUDGET = 5000
EXPERT_BUDGET = 6000
DOCUMENT_BUDGET = 20_000


def knn(metric: str, indexed: bool = False):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        vectors = table(spark, folder, "embeddings").select(
            F.col("label").cast("string").alias("collection"), F.col("vec_id").cast("string").alias("id"), "embedding"
        )
        questions = vectors.withColumnRenamed("id", "query_id")
        if indexed:
            found = BallIndex.build(vectors, metric).nearest(questions, fixed.N_RESULTS)
        else:
            found = nearest(vectors, questions, fixed.N_RESULTS, metric)
        return found.select(
            F.col("query_id").cast("long").alias("query_id"), F.col("collection").cast("int").alias("collection"),
            F.col("rank").cast("int").alias("rank"), F.col("id").cast("long").alias("id"),
            F.round("distance", 6).alias("distance"),
        )

    return query


def knn_sql(metric: str) -> str:
    q, s = "CAST(q.embedding AS DOUBLE[])", "CAST(s.embedding AS DOUBLE[])"
    distance = {
        "cosine": f"1 - list_cosine_similarity({q}, {s})",
        "l2": f"pow(list_distance({q}, {s}), 2)",
        "ip": f"1 - list_inner_product({q}, {s})",
    }[metric]
    return f"""
    WITH d AS (
      SELECT q.vec_id AS query_id, q.label AS collection, s.vec_id AS id, round({distance}, 10) + 0.0 AS distance
      FROM embeddings q JOIN embeddings s ON q.label = s.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, CAST(id AS VARCHAR)) AS rank FROM d)
    SELECT query_id, collection, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance
    FROM r WHERE rank <= {fixed.N_RESULTS}"""


def collection_order() -> Column:
    """The named collections in their order, then any others by name."""
    order = F.lit(len(GUIDANCE_COLLECTIONS))
    for i, name in enumerate(GUIDANCE_COLLECTIONS):
        order = F.when(F.col("collection") == name, i).otherwise(order)
    return F.struct(order.alias("named"), F.col("collection").alias("name"))


def guidance(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked context rows of every question over all language collections that the corpus has."""
    store = vector_store(spark, folder)
    names = earlier_documents(spark, folder).filter(F.length("content") > 0).groupBy().agg(F.collect_set("collection").alias("names"))  # one a language
    questions = conversation_questions(spark, folder).select("query_id", hashed_embedding("question").alias("embedding"))
    questions = questions.withColumn("collection", F.explode(F.lit(names.first()["names"]).cast("array<string>")))
    found = with_documents(nearest(store, questions, fixed.N_RESULTS), store)
    return guidance_results(found, collection_order(), budget=GUIDANCE_BUDGET)


def retrieve_guidance(spark: SparkSession, folder: str) -> DataFrame:
    return guidance(spark, folder).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("position").cast("int").alias("position"),
        "collection", "id", "source", F.round("score", 6).alias("score"),
        numbered(F.col("position"), F.col("document")).alias("line"),
    )


_QUESTIONS_SQL = """
questions AS (SELECT conv_id AS query_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)"""


def _ranked_sql(partition: str, same_collection: str) -> str:
    """Exact cosine ranks of q(key, slot, n) against s(key, slot, n)."""
    return f"""
dots AS (SELECT q.key AS query_id, s.key AS id, sum(q.n * s.n) AS dot FROM q JOIN s USING (slot) GROUP BY ALL),
qn AS (SELECT key AS query_id, sqrt(sum(n * n)) AS qn FROM q GROUP BY key),
sn AS (SELECT key AS id, sqrt(sum(n * n)) AS sn FROM s GROUP BY key),
pairs AS (
  SELECT qn.query_id, c.collection, c.id,
         round(1 - CASE WHEN qn * coalesce(sn, 0) > 0 THEN coalesce(dot, 0) / (qn * sn) ELSE 0 END, 10) + 0.0 AS distance
  FROM qn JOIN members c ON {same_collection} LEFT JOIN sn USING (id) LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = c.id),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id{partition} ORDER BY distance, id) AS rank FROM pairs)
  WHERE rank <= {fixed.N_RESULTS})"""


RETRIEVE_GUIDANCE_FIT = f"""
WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')}, {_QUESTIONS_SQL},
members AS (SELECT DISTINCT collection, content_hash AS id FROM chunks),
payload AS (SELECT content_hash AS id, any_value(content) AS document, any_value(source) AS source FROM chunks GROUP BY content_hash),
{slots_sql('q', 'questions', 'query_id', 'question')},
{slots_sql('s', 'payload', 'id', 'document')},
{_ranked_sql(', collection', 'true')},
kept AS (
  SELECT ranked.*, 1.0 - distance AS score, document, source,
         coalesce(list_position(['{"', '".join(GUIDANCE_COLLECTIONS)}'], collection), 99) AS co
  FROM ranked JOIN payload USING (id) WHERE 1.0 - distance >= {fixed.MIN_SCORE}),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, co, collection, rank) - 1 AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, co, collection, rank) AS b FROM kept) WHERE b = 1),
fit AS (
  SELECT *, sum(length(document)) OVER (PARTITION BY query_id ORDER BY position) AS upto
  FROM best WHERE position < {fixed.N_RESULTS})"""
RETRIEVE_GUIDANCE_SQL = f"""{RETRIEVE_GUIDANCE_FIT}
SELECT query_id, CAST(position AS INTEGER) AS position, collection, id, source, round(score, 6) AS score,
       '[source:' || position || '] ' || document AS line
FROM fit WHERE upto <= {GUIDANCE_BUDGET}"""


def expert(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked context rows of every benchmark item, asked of one collection with everything."""
    store = vector_store(spark, folder, single=True)
    questions = table(spark, folder, "benchmark").select(
        F.lit("default-knowledge").alias("collection"), F.col("item_id").cast("string").alias("query_id"),
        hashed_embedding("text").alias("embedding"),
    )
    found = with_documents(nearest(store, questions, fixed.N_RESULTS), store)
    return expert_results(found, budget=EXPERT_BUDGET)


def retrieve_expert(spark: SparkSession, folder: str) -> DataFrame:
    return expert(spark, folder).select(
        F.col("query_id").cast("long").alias("query_id"), F.col("position").cast("int").alias("position"),
        "id", F.round("score", 6).alias("score"), numbered(F.col("position"), F.col("document")).alias("line"),
    )


_EXPERT_SQL = f"""
WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')},
payload AS (SELECT content_hash AS id, arg_max(content, chunk_index) AS document, any_value(source) AS source,
                   any_value(title) AS title, any_value(document_id) AS document_id, max(chunk_index) AS chunk_index,
                   any_value(uri) AS uri FROM chunks GROUP BY content_hash),
members AS (SELECT 'default-knowledge' AS collection, id FROM payload),
{slots_sql('q', 'benchmark', 'item_id', 'text')},
{slots_sql('s', 'payload', 'id', 'document')},
{_ranked_sql('', 'true')},
kept AS (
  SELECT ranked.*, 1.0 - distance AS score, payload.* EXCLUDE (id),
         row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS position
  FROM ranked JOIN payload USING (id) WHERE 1.0 - distance >= {fixed.MIN_SCORE}),
fit AS (
  SELECT * FROM (SELECT *, sum(length(document)) OVER (PARTITION BY query_id ORDER BY position) AS upto FROM kept)
  WHERE upto <= {EXPERT_BUDGET})"""

RETRIEVE_EXPERT_SQL = f"""{_EXPERT_SQL}
SELECT query_id, CAST(position AS INTEGER) AS position, id, round(score, 6) AS score,
       '[source:' || position || '] ' || document AS line FROM fit"""


def sources_first(spark: SparkSession, folder: str) -> DataFrame:
    return first_per_source(expert(spark, folder)).select(
        F.col("query_id").cast("long").alias("query_id"), "document_id", "source", "title", "type",
        "embedding_type", "chunk_index", "uri", F.round("score", 6).alias("score"),
    )


SOURCES_FIRST_SQL = f"""{_EXPERT_SQL}
SELECT query_id, document_id, source, title, 'knowledge' AS type, 'chunk' AS embedding_type,
       CAST(chunk_index AS INTEGER) AS chunk_index, coalesce(nullif(uri, ''), source) AS uri, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY position) AS f FROM fit) WHERE f = 1"""


def expert_context(spark: SparkSession, folder: str) -> DataFrame:
    """One prompt context per question, as handed to the model."""
    kept = expert(spark, folder)
    return kept.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(
        ordered_lines(F.col("position"), numbered(F.col("position"), F.col("document")), "\n").alias("knowledge"),
        F.count("*").alias("n_chunks"), F.sum(F.length("document")).alias("n_chars"),
    )


EXPERT_CONTEXT_SQL = f"""{_EXPERT_SQL}
SELECT query_id, string_agg('[source:' || position || '] ' || document, chr(10) ORDER BY position) AS knowledge,
       count(*) AS n_chunks, CAST(sum(length(document)) AS BIGINT) AS n_chars FROM fit GROUP BY query_id"""


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Budget cut over all documents of a source, in id order: a group here has no bound on its size."""
    docs = table(spark, folder, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    upto = running_sum(docs, ["source"], "doc_id", "n", "upto")
    kept = F.col("upto") <= DOCUMENT_BUDGET
    return upto.groupBy("source").agg(
        F.count_if(kept).alias("kept_chunks"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept_chars"),
        F.count_if(~kept).alias("dropped_chunks"),
        F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("dropped_chars"),
    )


CONTEXT_BUDGET_SQL = f"""
WITH r AS (
  SELECT source, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) <= {DOCUMENT_BUDGET} AS kept
  FROM documents)
SELECT source, count(*) FILTER (WHERE kept) AS kept_chunks, CAST(coalesce(sum(n) FILTER (WHERE kept), 0) AS BIGINT) AS kept_chars,
       count(*) FILTER (WHERE NOT kept) AS dropped_chunks, CAST(coalesce(sum(n) FILTER (WHERE NOT kept), 0) AS BIGINT) AS dropped_chars
FROM r GROUP BY source"""


def retrieved_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text handed out while answering, flattened over all recorded results."""
    recorded = expert(spark, folder).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "document"))).alias("result")
    )
    return recorded.select(F.col("query_id").cast("long").alias("query_id"), F.explode("result").alias("r")).select(
        "query_id", F.col("r.position").cast("int").alias("position"), F.col("r.document").alias("context")
    )


RETRIEVED_CONTEXTS_SQL = f"""{_EXPERT_SQL}
SELECT query_id, CAST(position AS INTEGER) AS position, document AS context FROM fit"""

QUERIES = {
    "retrieve_guidance": (retrieve_guidance, RETRIEVE_GUIDANCE_SQL),
    "retrieve_expert": (retrieve_expert, RETRIEVE_EXPERT_SQL),
    "expert_context": (expert_context, EXPERT_CONTEXT_SQL),
    "sources_first": (sources_first, SOURCES_FIRST_SQL),
    "retrieved_contexts": (retrieved_contexts, RETRIEVED_CONTEXTS_SQL),
    "context_budget": (context_budget, CONTEXT_BUDGET_SQL),
    **{f"knn_{m}": (knn(m), knn_sql(m)) for m in ("cosine", "l2", "ip")},
    **{f"knn_index_{m}": (knn(m, indexed=True), knn_sql(m)) for m in ("cosine", "l2")},
}
