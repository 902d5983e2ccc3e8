"""The given tables read as the engine's data model, in Spark and as SQL text.

Two states of one corpus are derived from whole tables. *Earlier*: every document.
*Later*: what moderation makes of it - documents labelled toxic are gone, documents
labelled low in quality have their white space tidied, and the benchmark items have
been added as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.hashing import chunk_hash
from lorebase.functions.models import hashed_embedding
from lorebase.functions.splitting import window_at, window_chunks, window_count
from lorebase.functions.text import is_blank, let, single_spaced
from lorebase.session import materialised, scratch_folder
from lorebase.sources.store import ROW, KnowledgeStore, metadata_struct
from lorebase.sources.tables import table

CHUNK, OVERLAP = fixed.WEBSITE_CHUNK
STEP = CHUNK - OVERLAP

DOC_COLUMNS = ("collection", "document_id", "source", "type", "title", "uri", "content", "position")


def _document_row(content) -> list:
    return [
        F.concat("lang", F.lit("-knowledge")).alias("collection"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"),
        F.col("source"),
        F.lit("knowledge").alias("type"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
        F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("https://corpus.example/"), F.col("doc_id"))).alias("uri"),
        content.alias("content"),
        F.col("doc_id").alias("position"),
    ]


def earlier_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(*_document_row(F.col("text")))


def later_documents(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    judged = table(spark, folder, "documents").join(labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) != 1)
    edited = F.when(F.col("quality") == 0, single_spaced(F.col("text"))).otherwise(F.col("text"))
    added = table(spark, folder, "benchmark").select(
        F.lit("en-knowledge").alias("collection"),
        F.concat(F.lit("benchmark-"), F.col("item_id")).alias("document_id"),
        F.lit("benchmark").alias("source"),
        F.lit("knowledge").alias("type"),
        F.concat(F.lit("Item "), F.col("item_id")).alias("title"),
        F.lit(None).cast("string").alias("uri"),
        F.col("text").alias("content"),
        (F.lit(1 << 40) + F.col("item_id")).alias("position"),
    )
    return judged.select(*_document_row(edited)).unionByName(added)


def windows(content: Column) -> Column:
    """The corpus's window chunks of a text, as an array; null for none."""
    count = window_count(content, CHUNK, OVERLAP)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: window_at(content, i, CHUNK, OVERLAP))
    return F.when(count > 0, cut)


def hashed_chunks(documents: DataFrame) -> DataFrame:
    """Window chunks with their content addresses."""
    chunks = window_chunks(documents, CHUNK, OVERLAP)
    return chunks.withColumn(
        "content_hash",
        chunk_hash(F.col("content"), F.col("title"), F.col("source"), F.col("type"), F.col("document_id")),
    )


def distinct_chunks(documents: DataFrame) -> DataFrame:
    """:func:`hashed_chunks` without repeats of an address in a document; the last of them stays."""
    def entry(content: Column, at: Column) -> Column:
        address = chunk_hash(content, F.col("title"), F.col("source"), F.col("type"), F.col("document_id"))
        return F.struct(address.alias("content_hash"), (-at).alias("last_first"), content.alias("content"))

    entries = let(
        F.array_sort(F.transform(windows(F.col("content")), entry)),
        lambda sorted_: F.filter(sorted_, lambda e, i: (i == 0) | (F.get(sorted_, i - 1)["content_hash"] != e["content_hash"])),
    )
    kept = [c for c in documents.columns if c != "content"]
    exploded = documents.select(*kept, F.explode(entries).alias("_e"))
    return exploded.select(
        *kept, F.lit("chunk").alias("embedding_type"), (-F.col("_e.last_first")).alias("chunk_index"), "_e.content", "_e.content_hash"
    )


def stored_state(documents: DataFrame) -> DataFrame:
    """Store rows (without vectors) of an ingested corpus: chunks, and a summary row per large document.

    The address holds the document's id, so equal chunks meet inside one document and
    are dropped there, before they become rows: no text is shuffled. ``documents`` has
    one row per collection and document_id.
    """
    rows = distinct_chunks(documents).select(
        "collection", F.col("content_hash").alias("id"), F.col("content").alias("document"), metadata_struct().alias("metadata")
    )
    described = documents.filter(window_count(F.col("content"), CHUNK, OVERLAP) >= fixed.SUMMARY_MIN_CHUNKS).select(
        "collection",
        F.concat("document_id", F.lit("-summary")).alias("document_id"),
        "source", "type", "title",
        F.lit("summary").alias("embedding_type"),
        F.lit(0).alias("chunk_index"),
        F.lit(None).cast("string").alias("uri"),
    )
    summaries = described.select(
        "collection", F.concat("document_id", F.lit("-0")).alias("id"), F.col("title").alias("document"),
        metadata_struct().alias("metadata"),
    )
    return rows.unionByName(summaries)


def content_vector(content: Column) -> Column:
    """Eight whole numbers from a text's hash, as floats: the vectors of the store queries, which SQL can check.

    A blank text gets none, as from a model that has nothing to embed.
    """
    pair = lambda h, i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("float")
    return F.when(~is_blank(content), let(F.sha2(content, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: pair(h, i))))


def store_rows_with_vectors(documents: DataFrame) -> DataFrame:
    """:func:`stored_state` with vectors, without rows that have none."""
    rows = stored_state(documents).withColumn("embedding", content_vector(F.col("document")))
    return rows.filter(F.col("embedding").isNotNull()).select(*ROW.names)


def knowledge_store(spark: SparkSession, rows: DataFrame) -> KnowledgeStore:
    """A new store in the shared folder that holds the rows."""
    store = KnowledgeStore(spark, scratch_folder(spark, "store"))
    store.upsert(rows)
    return store


def vector_store(spark: SparkSession, folder: str, single: bool = False) -> DataFrame:
    """Embedded chunks of all documents, one collection per language or a single one.

    A plan, not a table: the search reads ids and vectors of it in one pass over the corpus,
    the fetch ids and texts of the winners in another, without vectors.
    """
    chunks = hashed_chunks(earlier_documents(spark, folder))
    collection = F.lit("default-knowledge") if single else F.col("collection")
    return chunks.select(
        collection.alias("collection"), F.col("content_hash").alias("id"), F.col("content").alias("document"),
        metadata_struct().alias("metadata"), hashed_embedding("content").alias("embedding"),
    )


def conversation_questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, question): the last user turn of every conversation."""
    turns = table(spark, folder, "conversations").filter(F.col("role") == "user")
    return turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).select(
        F.col("conv_id").cast("string").alias("query_id"), "question"
    )


# -- the same in SQL ----------------------------------------------------------------

EARLIER_SQL = """
earlier AS (
  SELECT lang || '-knowledge' AS collection, 'doc-' || doc_id AS document_id, source, 'knowledge' AS type,
         'Document ' || doc_id AS title,
         CASE WHEN lang = 'en' THEN '' ELSE 'https://corpus.example/' || doc_id END AS uri,
         text AS content, doc_id AS position
  FROM documents)"""


def single_spaced_sql(column: str) -> str:
    ws = fixed.WS_RE2
    return f"regexp_replace(regexp_replace({column}, '{ws}+', ' ', 'g'), '^{ws}+|{ws}+$', '', 'g')"


LATER_SQL = f"""
later AS (
  SELECT lang || '-knowledge' AS collection, 'doc-' || doc_id AS document_id, source, 'knowledge' AS type,
         'Document ' || doc_id AS title,
         CASE WHEN lang = 'en' THEN '' ELSE 'https://corpus.example/' || doc_id END AS uri,
         CASE WHEN quality = 0 THEN {single_spaced_sql('text')} ELSE text END AS content, doc_id AS position
  FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) <> 1
  UNION ALL
  SELECT 'en-knowledge', 'benchmark-' || item_id, 'benchmark', 'knowledge', 'Item ' || item_id, NULL, text,
         (1::BIGINT << 40) + item_id
  FROM benchmark)"""


def chunks_sql(name: str, documents: str, size: int = CHUNK, overlap: int = OVERLAP) -> str:
    step = size - overlap
    return f"""
{name} AS (
  SELECT * EXCLUDE (content, whole), content,
         sha256(content || chr(0) || title || chr(0) || source || chr(0) || type || chr(0) || document_id) AS content_hash
  FROM (SELECT * EXCLUDE (content), content AS whole, substr(content, chunk_index * {step} + 1, {size}) AS content
        FROM (SELECT *, CAST(unnest(generate_series(0, greatest(0, CAST(ceil((length(content) - {size}) / {step}.0) AS BIGINT)))) AS INTEGER)
                     AS chunk_index FROM {documents} WHERE length(content) > 0)))"""


def store_sql(name: str, documents: str, chunks: str) -> str:
    return f"""
{name} AS (
  SELECT collection, content_hash AS id, arg_max(content, chunk_index) AS document, any_value(document_id) AS documentId,
         any_value(source) AS source, any_value(title) AS title, 'chunk' AS embeddingType,
         max(chunk_index) AS chunkIndex, nullif(any_value(uri), '') AS uri
  FROM {chunks} GROUP BY collection, content_hash
  UNION ALL
  SELECT collection, document_id || '-summary-0', title, document_id || '-summary', source, title, 'summary', 0, NULL
  FROM {documents} WHERE (collection, document_id) IN
    (SELECT (collection, document_id) FROM {chunks} GROUP BY collection, document_id HAVING count(*) >= {fixed.SUMMARY_MIN_CHUNKS}))"""


def vector_sum_sql(content: str) -> str:
    """Sum of a content vector; null for a blank text."""
    digit = "(instr('0123456789abcdef', substr(sha256({c}), {i}, 1)) - 1)"
    parts = " + ".join(f"{digit.format(c=content, i=i)} * {16 if i % 2 else 1}" for i in range(1, 17))
    return f"CASE WHEN {not_blank_sql(content)} THEN {parts} END"


def not_blank_sql(column: str) -> str:
    return f"regexp_replace({column}, '{fixed.WS_RE2}+', '', 'g') <> ''"


def slots_sql(name: str, source: str, key: str, text: str) -> str:
    """Token counts per slot: the hashed embedding in long form."""
    nibble = "(instr('0123456789abcdef', substr(md5(token), {i}, 1)) - 1)"
    slot = f"({nibble.format(i=1)} * 16 + {nibble.format(i=2)}) % 64"
    return f"""
{name} AS (
  SELECT key, slot, CAST(sum(n) AS DOUBLE) AS n FROM (
    SELECT key, {slot} AS slot, n FROM (
      SELECT key, token, count(*) AS n FROM (
        SELECT {key} AS key, unnest(regexp_split_to_array(lower({text}), '{fixed.WS_RE2}+')) AS token FROM {source})
      WHERE token <> '' GROUP BY key, token))
  GROUP BY key, slot)"""
