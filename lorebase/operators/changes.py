"""Comparison of freshly cut chunks with what the store holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import fixed

UNCHANGED, NEW, ORPHAN, REMOVED = "unchanged", "new", "orphan", "removed"


def _addresses(chunks: DataFrame) -> DataFrame:
    """Distinct (collection, document, hash); equal chunks of one document count together."""
    return (
        chunks.filter((F.col("embedding_type") == "chunk") & F.col("content_hash").isNotNull())
        .groupBy("collection", "document_id", F.col("content_hash").alias("id"))
        .agg(F.count("*").alias("copies"))
    )


def difference(chunks: DataFrame, store: DataFrame, all_documents: DataFrame | None = None) -> DataFrame:
    """(collection, document_id, id, status, copies): one row per address and state.

    * unchanged - the address is stored for this document
    * new       - it is not
    * orphan    - a stored row of a document that has chunks now, but not this one
    * removed   - a stored chunk row of a document that is not in ``all_documents``

    Addresses meet on a key with the content hash, so one huge document spreads over all
    tasks. Only addresses that are stored but no longer cut then meet their document's
    flags; a document with very many of those relies on the adaptive skew split. Stored rows of documents that are still listed but give no chunks stay.
    """
    now = _addresses(chunks)
    # counts every column of ``now``, so that both uses of it share one shuffle
    chunked = now.groupBy("collection", "document_id").agg((F.sum("copies") > 0).alias("has_chunks"))
    if all_documents is None:
        documents = chunked.withColumn("listed", F.col("has_chunks"))
    else:
        listed = all_documents.select("collection", "document_id").distinct().withColumn("listed", F.lit(True))
        documents = listed.join(chunked, ["collection", "document_id"], "full")
    held = store.select(
        "collection",
        F.col("metadata.documentId").alias("document_id"),
        "id",
        F.col("metadata.embeddingType").alias("held_type"),
    )
    address = ["collection", "document_id", "id"]
    stored = F.col("held_type").isNotNull()
    cut = now.join(held, address, "left").select(*address, F.when(stored, UNCHANGED).otherwise(NEW).alias("status"), "copies")
    gone = F.when(F.col("has_chunks"), ORPHAN).when(
        F.col("listed").isNull() & (F.col("held_type") == "chunk") & (F.col("document_id") != ""), REMOVED
    )
    left = held.join(now.select(*address), address, "left_anti").join(documents, ["collection", "document_id"], "left")
    dropped = left.select(*address, gone.alias("status"), F.lit(0).cast("bigint").alias("copies"))
    return cut.unionByName(dropped.filter(F.col("status").isNotNull()))


def changed_documents(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status").isin(NEW, ORPHAN)).select("collection", "document_id").distinct()


def removed_documents(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status") == REMOVED).select("collection", "document_id").distinct()


def orphan_ids(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("status") == ORPHAN).select("collection", "document_id", "id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection", "document_id").agg(F.count("*").alias("n_chunks"))


def summary_candidates(chunks: DataFrame, changed: DataFrame | None, min_chunks: int = fixed.SUMMARY_MIN_CHUNKS) -> DataFrame:
    """Documents to summarise: enough chunks and, where a comparison ran, changed."""
    large = chunk_counts(chunks).filter(F.col("n_chunks") >= min_chunks)
    return large if changed is None else large.join(changed, ["collection", "document_id"], "left_semi")


def summary_id(document_id: Column) -> Column:
    return F.concat(document_id, F.lit("-summary-0"))


def stale_summaries(chunks: DataFrame, changed: DataFrame, min_chunks: int = fixed.SUMMARY_MIN_CHUNKS) -> DataFrame:
    """Summary ids of changed documents that no longer have enough chunks."""
    small = chunk_counts(chunks).filter(F.col("n_chunks") < min_chunks)
    return small.join(changed, ["collection", "document_id"], "left_semi").select(
        "collection", "document_id", summary_id(F.col("document_id")).alias("id")
    )


def reuse_embeddings(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Left join that hands the stored vector to every unchanged chunk."""
    held = store.select(
        "collection",
        F.col("metadata.documentId").alias("document_id"),
        F.col("id").alias("content_hash"),
        F.col("embedding"),
        F.lit(True).alias("unchanged"),
    )
    joined = chunks.join(held, ["collection", "document_id", "content_hash"], "left")
    return joined.withColumn("unchanged", F.coalesce("unchanged", F.lit(False)))
