"""Change detection and store states between the two corpus states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.hashing import chunk_hash, storage_id
from lorebase.operators import changes
from lorebase.plans.corpus import (
    EARLIER_SQL, LATER_SQL, chunks_sql, content_vector, earlier_documents, hashed_chunks, knowledge_store, later_documents,
    not_blank_sql, store_rows_with_vectors, store_sql, stored_state, vector_sum_sql, windows,
)
from lorebase.session import broadcast_measured, checkpoint, materialised
from lorebase.sources.store import KnowledgeStore, metadata_struct


def _later(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Addresses of the later state's chunks, and its documents' keys: cut and hashed once, without texts."""
    documents = later_documents(spark, folder)
    # an outer explode, so that a document without chunks keeps its row
    address = chunk_hash(F.col("_c"), F.col("title"), F.col("source"), F.col("type"), F.col("document_id"))
    cut = materialised(
        documents.select(*[c for c in documents.columns if c != "content"], F.explode_outer(windows(F.col("content"))).alias("_c"))
        .select("collection", "document_id", F.lit("chunk").alias("embedding_type"),
                F.when(F.col("_c").isNotNull(), address).alias("content_hash"))
    )
    return cut.filter(F.col("content_hash").isNotNull()), cut.select("collection", "document_id").distinct()


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier state's store, written once: most readers take its addresses only."""
    return materialised(stored_state(earlier_documents(spark, folder)))


def _chunks_and_diff(spark: SparkSession, folder: str, store: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    chunks, documents = _later(spark, folder)
    store = stored_state(earlier_documents(spark, folder)) if store is None else store
    return chunks, changes.difference(chunks, store, documents)


def _difference(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks_and_diff(spark, folder)[1]


def change_detection(spark: SparkSession, folder: str) -> DataFrame:
    return _difference(spark, folder)


_BASE_SQL = f"""
WITH {EARLIER_SQL}, {LATER_SQL}, {chunks_sql('old_chunks', 'earlier')}, {chunks_sql('chunks', 'later')},
{store_sql('store', 'earlier', 'old_chunks')},
now AS (SELECT collection, document_id, content_hash AS id, count(*) AS copies FROM chunks GROUP BY ALL),
diff AS (
  SELECT n.collection, n.document_id, n.id, CASE WHEN s.id IS NULL THEN 'new' ELSE 'unchanged' END AS status, copies
  FROM now n LEFT JOIN store s ON s.collection = n.collection AND s.documentId = n.document_id AND s.id = n.id
  UNION ALL
  SELECT s.collection, s.documentId, s.id, 'orphan', 0 FROM store s
  WHERE (s.collection, s.documentId) IN (SELECT (collection, document_id) FROM now)
    AND (s.collection, s.documentId, s.id) NOT IN (SELECT (collection, document_id, id) FROM now)
  UNION ALL
  SELECT s.collection, s.documentId, s.id, 'removed', 0 FROM store s
  WHERE embeddingType = 'chunk' AND (s.collection, s.documentId) NOT IN (SELECT (collection, document_id) FROM later)),
changed AS (SELECT DISTINCT collection, document_id FROM diff WHERE status IN ('new', 'orphan')),
removed AS (SELECT DISTINCT collection, document_id FROM diff WHERE status = 'removed'),
counts AS (SELECT collection, document_id, count(*) AS n_chunks FROM chunks GROUP BY ALL)"""
CHANGE_DETECTION_SQL = f"{_BASE_SQL} SELECT collection, document_id, id, status, copies FROM diff"


def change_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per collection and state; skipped chunks count every copy."""
    return _difference(spark, folder).groupBy("collection", "status").agg(
        F.count("*").alias("addresses"), F.sum("copies").alias("chunks"), F.countDistinct("document_id").alias("documents")
    )


CHANGE_SUMMARY_SQL = f"""{_BASE_SQL}
SELECT collection, status, count(*) AS addresses, CAST(sum(copies) AS BIGINT) AS chunks, count(DISTINCT document_id) AS documents
FROM diff GROUP BY ALL"""


def changed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return changes.changed_documents(_difference(spark, folder))


def removed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return changes.removed_documents(_difference(spark, folder))


def orphan_ids(spark: SparkSession, folder: str) -> DataFrame:
    return changes.orphan_ids(_difference(spark, folder))


def summary_candidates(spark: SparkSession, folder: str) -> DataFrame:
    chunks, diff = _chunks_and_diff(spark, folder)
    return changes.summary_candidates(chunks, changes.changed_documents(diff))


SUMMARY_CANDIDATES_SQL = f"""{_BASE_SQL}
SELECT collection, document_id, n_chunks FROM counts
WHERE n_chunks >= {fixed.SUMMARY_MIN_CHUNKS} AND (collection, document_id) IN (SELECT (collection, document_id) FROM changed)"""


def stale_summaries(spark: SparkSession, folder: str) -> DataFrame:
    chunks, diff = _chunks_and_diff(spark, folder)
    return changes.stale_summaries(chunks, changes.changed_documents(diff))


STALE_SUMMARIES_SQL = f"""{_BASE_SQL}
SELECT collection, document_id, document_id || '-summary-0' AS id FROM counts
WHERE n_chunks < {fixed.SUMMARY_MIN_CHUNKS} AND (collection, document_id) IN (SELECT (collection, document_id) FROM changed)"""


def reused_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of a document that take over their stored vector, the sum of those vectors, and the chunks left to embed."""
    chunks, store = _later(spark, folder)[0], knowledge_store(spark, store_rows_with_vectors(earlier_documents(spark, folder)))
    marked = changes.reuse_embeddings(chunks, store.read())
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return marked.groupBy("collection", "document_id").agg(
        F.count("embedding").alias("reused"), F.coalesce(F.sum(total), F.lit(0)).alias("vector_sum"), F.count_if(F.col("embedding").isNull()).alias("to_embed")
    )


REUSED_SQL = f"""{_BASE_SQL},
held AS (SELECT collection, documentId, id, {vector_sum_sql('document')} AS v FROM store WHERE {not_blank_sql('document')})
SELECT c.collection, c.document_id, count(s.id) AS reused, CAST(coalesce(sum(s.v), 0) AS BIGINT) AS vector_sum, count(*) FILTER (WHERE s.id IS NULL) AS to_embed
FROM chunks c LEFT JOIN held s ON s.collection = c.collection AND s.documentId = c.document_id AND s.id = c.content_hash
GROUP BY ALL"""


def _flat(store: DataFrame) -> DataFrame:
    return store.select("collection", "id", "document", "metadata.documentId", "metadata.source", "metadata.title",
                        "metadata.embeddingType", "metadata.chunkIndex", "metadata.uri")


def _upsert(spark: SparkSession, folder: str) -> tuple[KnowledgeStore, DataFrame, DataFrame]:
    """The store after the upsert of what is new, the difference, and the later chunks.

    New addresses and changed documents are narrow tables: written, measured, and met by the
    documents' rows before any text is cut.
    """
    store = knowledge_store(spark, store_rows_with_vectors(earlier_documents(spark, folder)))
    chunks, diff = _chunks_and_diff(spark, folder, store.read())
    diff = checkpoint(diff)  # narrow, and read several times
    new = diff.filter(F.col("status") == changes.NEW)
    documents = later_documents(spark, folder)
    touched = documents.join(broadcast_measured(new.select("collection", "document_id").distinct(), 80), ["collection", "document_id"], "left_semi")
    cut = store_rows_with_vectors(touched).filter(F.col("metadata.embeddingType") == "chunk")
    fresh = cut.join(broadcast_measured(new.select("collection", "id"), 120), ["collection", "id"], "left_semi")
    summaries = store_rows_with_vectors(documents).filter(F.col("metadata.embeddingType") == "summary")
    store.upsert(fresh.unionByName(summaries))
    return store, diff, chunks


def store_upsert_state(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_upsert(spark, folder)[0].read())


_UPSERT_SQL = f"""{_BASE_SQL},
{store_sql('incoming', 'later', 'chunks')},
fresh AS (SELECT * FROM incoming WHERE (collection, id) NOT IN (SELECT (collection, id) FROM diff WHERE status = 'unchanged')),
upserted AS (
  SELECT * FROM store WHERE (collection, id) NOT IN (SELECT (collection, id) FROM fresh) UNION ALL SELECT * FROM fresh)"""
_FLAT_SQL = 'collection, id, document, documentId, source, title, embeddingType, CAST(chunkIndex AS INTEGER) AS chunkIndex, uri'
STORE_UPSERT_SQL = f"{_UPSERT_SQL} SELECT {_FLAT_SQL} FROM upserted"


def orphan_cleanup_state(spark: SparkSession, folder: str) -> DataFrame:
    """The store after upsert and clean-up: orphans, stale summaries and removed documents are gone."""
    store, diff, chunks = _upsert(spark, folder)
    doomed = changes.orphan_ids(diff).select("collection", "id").unionByName(
        changes.stale_summaries(chunks, changes.changed_documents(diff)).select("collection", "id")
    )
    store.delete_ids(doomed)
    store.delete_documents(changes.removed_documents(diff))
    store.compact()
    return _flat(store.read())


ORPHAN_CLEANUP_SQL = f"""{_UPSERT_SQL},
stale AS (SELECT collection, document_id || '-summary-0' AS id FROM counts
          WHERE n_chunks < {fixed.SUMMARY_MIN_CHUNKS} AND (collection, document_id) IN (SELECT (collection, document_id) FROM changed)),
doomed AS (SELECT collection, id FROM diff WHERE status = 'orphan' UNION SELECT collection, id FROM stale)
SELECT {_FLAT_SQL} FROM upserted
WHERE (collection, id) NOT IN (SELECT (collection, id) FROM doomed)
  AND (collection, documentId) NOT IN (SELECT (collection, document_id) FROM removed)
  AND (collection, documentId) NOT IN (SELECT (collection, document_id || '-summary') FROM removed)"""


def storage_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Storage ids and stored metadata of chunks, with and without a content hash."""
    chunks = hashed_chunks(earlier_documents(spark, folder))
    meta = metadata_struct()
    plain = storage_id(F.lit("knowledge"), F.lit(None).cast("string"), F.col("document_id"), F.col("chunk_index"))
    return chunks.select(
        storage_id(F.col("embedding_type"), F.col("content_hash"), F.col("document_id"), F.col("chunk_index")).alias("id"),
        plain.alias("plain_id"), meta["documentId"].alias("documentId"), meta["chunkIndex"].alias("chunkIndex"), meta["uri"].alias("uri"),
    )


STORAGE_IDS_SQL = f"""WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')}
SELECT content_hash AS id, document_id || '-' || chunk_index AS plain_id, document_id AS documentId,
       chunk_index AS chunkIndex, nullif(uri, '') AS uri FROM chunks"""


def _earlier_store(spark: SparkSession, folder: str) -> KnowledgeStore:
    return knowledge_store(spark, store_rows_with_vectors(earlier_documents(spark, folder)))


def store_get_where(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by metadata equality: the stored summaries, with their metadata only."""
    found = _earlier_store(spark, folder).get(None, where={"embeddingType": "summary"}, include=["metadata"])
    return _flat(found.withColumn("document", F.lit(None))).drop("document")


_OLD_SQL = f"WITH {EARLIER_SQL}, {chunks_sql('old_chunks', 'earlier')}, {store_sql('store', 'earlier', 'old_chunks')}"
STORE_GET_WHERE_SQL = f"""{_OLD_SQL}
SELECT collection, id, documentId, source, title, embeddingType, CAST(chunkIndex AS INTEGER) AS chunkIndex, uri
FROM store WHERE embeddingType = 'summary'"""


def store_get_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by id: what the store still holds of the later state's addresses."""
    chunks = _later(spark, folder)[0]
    return _earlier_store(spark, folder).get_rows(chunks.select("collection", F.col("content_hash").alias("id")), include=["document"])


STORE_GET_IDS_SQL = f"""{_BASE_SQL}
SELECT collection, id, document FROM store WHERE (collection, id) IN (SELECT (collection, content_hash) FROM chunks)"""


def store_delete_where(spark: SparkSession, folder: str) -> DataFrame:
    store = _earlier_store(spark, folder)
    store.delete_where(None, source="src3")
    return store.read().select("collection", "id", "metadata.source")


STORE_DELETE_WHERE_SQL = f"{_OLD_SQL} SELECT collection, id, source FROM store WHERE source IS DISTINCT FROM 'src3'"


def store_combine(spark: SparkSession, folder: str) -> DataFrame:
    """Results of several reads as one list, repeats included."""
    earlier = stored_state(earlier_documents(spark, folder)).select("collection", "id")
    later = stored_state(later_documents(spark, folder)).select("collection", "id")
    return earlier.unionByName(later)


STORE_COMBINE_SQL = f"""{_BASE_SQL}, {store_sql('incoming', 'later', 'chunks')}
SELECT collection, id FROM store UNION ALL SELECT collection, id FROM incoming"""


def all_known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Set union of the addresses of both states."""
    return store_combine(spark, folder).distinct()


ALL_KNOWN_IDS_SQL = f"""{_BASE_SQL}, {store_sql('incoming', 'later', 'chunks')}
SELECT collection, id FROM store UNION SELECT collection, id FROM incoming"""


def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Result row of a re-ingest per collection: processed, stored, skipped, deleted, errors, success.

    A new chunk without a vector is an error of its collection, as in :func:`plans.ingest.ingest`.
    """
    documents = later_documents(spark, folder)
    bare = documents.select("collection", F.explode(windows(F.col("content"))).alias("_c")).filter(content_vector(F.col("_c")).isNull())
    problems = bare.groupBy("collection").agg(F.count("*").alias("errors"))
    chunks, diff = _chunks_and_diff(spark, folder)
    diff = checkpoint(diff)
    changed = changes.changed_documents(diff)
    tallied = diff.groupBy("collection").agg(
        F.sum(F.when(F.col("status") == changes.NEW, F.col("copies")).otherwise(0)).alias("chunks_stored"),
        F.sum(F.when(F.col("status") == changes.UNCHANGED, F.col("copies")).otherwise(0)).alias("chunks_skipped"),
        F.count_if(F.col("status") == changes.ORPHAN).alias("orphans"),
        F.countDistinct(F.when(F.col("status") == changes.REMOVED, F.col("document_id"))).alias("removed"),
    )
    stale = changes.stale_summaries(chunks, changed).groupBy("collection").agg(F.count("*").alias("stale"))
    processed = documents.groupBy("collection").agg(F.count("*").alias("documents_processed"))
    return processed.join(tallied, "collection", "left").join(stale, "collection", "left").join(problems, "collection", "left").select(
        "collection", "documents_processed",
        F.coalesce("chunks_stored", F.lit(0)).alias("chunks_stored"),
        F.coalesce("chunks_skipped", F.lit(0)).alias("chunks_skipped"),
        (F.coalesce("orphans", F.lit(0)) + F.coalesce("stale", F.lit(0)) + F.coalesce("removed", F.lit(0))).alias("chunks_deleted"),
        F.coalesce("errors", F.lit(0)).alias("errors"), (F.coalesce("errors", F.lit(0)) == 0).alias("success"),
    )


INGEST_SUMMARY_SQL = f"""{_BASE_SQL},
t AS (
  SELECT collection, coalesce(sum(copies) FILTER (WHERE status = 'new'), 0) AS st, coalesce(sum(copies) FILTER (WHERE status = 'unchanged'), 0) AS sk,
         count(*) FILTER (WHERE status = 'orphan') AS o, count(DISTINCT document_id) FILTER (WHERE status = 'removed') AS r
  FROM diff GROUP BY 1),
s AS (SELECT collection, count(*) AS n FROM counts WHERE n_chunks < {fixed.SUMMARY_MIN_CHUNKS}
        AND (collection, document_id) IN (SELECT (collection, document_id) FROM changed) GROUP BY 1),
e AS (SELECT collection, count(*) AS errors FROM chunks WHERE NOT {not_blank_sql('content')} GROUP BY 1),
p AS (SELECT collection, count(*) AS documents_processed FROM later GROUP BY 1)
SELECT collection, documents_processed, CAST(coalesce(st, 0) AS BIGINT) AS chunks_stored, CAST(coalesce(sk, 0) AS BIGINT) AS chunks_skipped,
       CAST(coalesce(o, 0) + coalesce(n, 0) + coalesce(r, 0) AS BIGINT) AS chunks_deleted,
       coalesce(errors, 0) AS errors, coalesce(errors, 0) = 0 AS success
FROM p LEFT JOIN t USING (collection) LEFT JOIN s USING (collection) LEFT JOIN e USING (collection)"""

QUERIES = {
    "change_detection": (change_detection, CHANGE_DETECTION_SQL),
    "change_summary": (change_summary, CHANGE_SUMMARY_SQL),
    "changed_documents": (changed_documents, f"{_BASE_SQL} SELECT collection, document_id FROM changed"),
    "removed_documents": (removed_documents, f"{_BASE_SQL} SELECT collection, document_id FROM removed"),
    "orphan_ids": (orphan_ids, f"{_BASE_SQL} SELECT collection, document_id, id FROM diff WHERE status = 'orphan'"),
    "summary_candidates": (summary_candidates, SUMMARY_CANDIDATES_SQL),
    "stale_summaries": (stale_summaries, STALE_SUMMARIES_SQL),
    "reused_embeddings": (reused_embeddings, REUSED_SQL),
    "store_upsert_state": (store_upsert_state, STORE_UPSERT_SQL),
    "orphan_cleanup_state": (orphan_cleanup_state, ORPHAN_CLEANUP_SQL),
    "storage_ids": (storage_ids, STORAGE_IDS_SQL),
    "store_get_where": (store_get_where, STORE_GET_WHERE_SQL),
    "store_get_ids": (store_get_ids, STORE_GET_IDS_SQL),
    "store_delete_where": (store_delete_where, STORE_DELETE_WHERE_SQL),
    "store_combine": (store_combine, STORE_COMBINE_SQL),
    "all_known_ids": (all_known_ids, ALL_KNOWN_IDS_SQL),
    "ingest_summary": (ingest_summary, INGEST_SUMMARY_SQL),
}
