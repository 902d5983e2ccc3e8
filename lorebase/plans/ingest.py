"""Ingest of a corpus into the knowledge store, set-wise over any number of collections.

chunk -> address -> compare with the store -> summarise what changed -> embed what is
new -> upsert -> overview of changed collections -> clean-up. Batches of documents bound
the memory of a loop; here the rows of a stage are already spread over tasks, so every
stage runs once over everything. Model output is checkpointed before it is used, so that
a lost executor repeats no model call.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions import html, urls
from lorebase.functions.hashing import chunk_hash
from lorebase.functions.models import ModelPorts
from lorebase.functions.splitting import recursive_chunks
from lorebase.functions.text import is_blank
from lorebase.operators import changes
from lorebase.operators.boilerplate import without_boilerplate
from lorebase.operators.ordering import sorted_positions
from lorebase.operators.summaries import (
    document_summaries, overview, overview_rows, sections, summary_rows,
)
from lorebase.session import checkpoint, materialised
from lorebase.sources.store import KnowledgeStore, store_rows

DOCUMENT_COLUMNS = ("collection", "document_id", "source", "type", "title", "uri", "content", "position")


@dataclass
class IngestOutcome:
    """What an ingest did: one row per collection, and the error messages."""

    results: DataFrame
    errors: DataFrame
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)


def addressed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn(
        "content_hash", chunk_hash(F.col("content"), F.col("title"), F.col("source"), F.col("type"), F.col("document_id"))
    )


class _Steps:
    """Step metrics: duration and rows in and out, in the order the steps ran."""

    def __init__(self) -> None:
        self.metrics: dict[str, dict[str, float]] = {}

    def run(self, name: str, rows_in: int, work) -> DataFrame:
        start = time.monotonic()
        done = checkpoint(work())
        self.metrics[name] = {
            "duration": time.monotonic() - start, "items_in": rows_in, "items_out": done.count(), "error_count": 0,
        }
        return done

    def fail(self, name: str, errors: int) -> None:
        self.metrics.setdefault(name, {"duration": 0.0, "items_in": 0, "items_out": 0, "error_count": 0})["error_count"] += errors


def _count_by(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    counted = F.count("*") if condition is None else F.count_if(condition)
    return df.groupBy("collection").agg(counted.alias(name))


def collections_needing_overview(diff: DataFrame, store: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections with changes or removals, and those without an overview row."""
    touched = diff.filter(F.col("status") != changes.UNCHANGED).select("collection").distinct()
    have = store.filter(F.col("metadata.documentId") == fixed.OVERVIEW_DOC_ID).select("collection").distinct()
    return collections.join(have, "collection", "left_anti").unionByName(touched).distinct()


def ingest(
    store: KnowledgeStore,
    documents: DataFrame,
    ports: ModelPorts = ModelPorts(),
    size: int = fixed.WEBSITE_CHUNK[0],
    overlap: int = fixed.WEBSITE_CHUNK[1],
    min_chunks: int = fixed.SUMMARY_MIN_CHUNKS,
    summarize: bool = True,
) -> IngestOutcome:
    """Bring the collections of ``documents`` up to date; all their documents have to be listed."""
    if min_chunks < 1:
        raise ValueError("min_chunks must be >= 1")
    steps = _Steps()
    documents = materialised(documents)  # every stage reads them, and what they come from may be costly
    collections = checkpoint(documents.select("collection").distinct())
    # names only, as many as the manifest lists anyway; they prune the scan to their folders
    current = store.read([r[0] for r in collections.collect()])
    n_documents = documents.count()

    chunks = steps.run("chunk", n_documents, lambda: addressed(recursive_chunks(documents, size, overlap)))
    n_chunks = int(steps.metrics["chunk"]["items_out"])
    diff = steps.run("change_detection", n_chunks, lambda: changes.difference(chunks, current, documents))
    changed = changes.changed_documents(diff)

    fresh = chunks.join(
        diff.filter(F.col("status") == changes.NEW).select("collection", "document_id", F.col("id").alias("content_hash")),
        ["collection", "document_id", "content_hash"], "left_semi",
    )
    errors = []
    parts = [fresh]
    no_summaries = chunks.select("collection", "document_id", F.lit("").alias("summary")).limit(0)
    summaries = no_summaries
    if summarize:
        wanted = changes.summary_candidates(chunks, changed, min_chunks)
        raw = steps.run("document_summary", n_chunks, lambda: document_summaries(chunks, wanted, ports, materialise=checkpoint))
        blank = wanted.join(raw.filter(~is_blank(F.col("summary"))), ["collection", "document_id"], "left_anti")
        errors.append(blank.select("collection", F.concat(
            F.lit("document_summary: no content for "), F.col("document_id")).alias("error")))
        summaries = raw.filter(~is_blank(F.col("summary")))
        parts.append(summary_rows(summaries, documents))

    columns = ["collection", "document_id", "source", "type", "title", "uri", "embedding_type", "chunk_index", "content", "content_hash"]
    to_embed = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    embedded = steps.run("embed", n_chunks, lambda: to_embed.withColumn("embedding", ports.embed(F.col("content"))))
    errors.append(_count_by(embedded, "n", F.col("embedding").isNull()).filter("n > 0").select(
        "collection", F.concat(F.lit("store: skipped "), F.col("n"), F.lit(" chunks without embeddings")).alias("error")))
    rows = steps.run("store", int(steps.metrics["embed"]["items_out"]), lambda: store_rows(embedded))
    store.upsert(rows)
    stored = [embedded.filter(F.col("embedding").isNotNull()).select("collection")]

    orphans = [changes.orphan_ids(diff).select("collection", "id")]
    if summarize:
        orphans.append(changes.stale_summaries(chunks, changed, min_chunks).select("collection", "id"))
        due = collections_needing_overview(diff, current, collections)
        texts = sections(documents, chunks, summaries).join(due, "collection", "left_semi")
        made = steps.run("body_of_knowledge_summary", n_documents, lambda: overview(texts, ports, materialise=checkpoint))
        overviews = checkpoint(overview_rows(made.filter(~is_blank(F.col("summary")))).withColumn("embedding", ports.embed(F.col("content"))))
        store.upsert(store_rows(overviews))
        stored.append(overviews.select("collection"))
        emptied = changes.removed_documents(diff).select("collection").distinct().join(chunks, "collection", "left_anti")
        orphans.append(emptied.select("collection", F.lit(f"{fixed.OVERVIEW_DOC_ID}-0").alias("id")))

    problems = checkpoint(reduce(DataFrame.unionByName, errors))
    doomed = checkpoint(reduce(DataFrame.unionByName, orphans).distinct())
    removed = checkpoint(changes.removed_documents(diff))
    deleted, gate = clean_up(store, doomed, removed, problems)
    steps.fail("orphan_cleanup", gate.count())

    problems = problems.unionByName(gate)
    return IngestOutcome(
        result_rows(collections, documents, diff, stored, deleted, problems), problems, steps.metrics
    )


def clean_up(store: KnowledgeStore, doomed: DataFrame, removed: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete orphans and removed documents, except in collections where a step has failed.

    Returns the deletions per collection and a message for every collection held back.
    """
    failed = problems.groupBy("collection").agg(F.count("*").alias("n"))
    ids = doomed.join(failed, "collection", "left_anti")
    documents = removed.join(failed, "collection", "left_anti")
    # counted as the rows to delete, stored or not, and one per removed document
    deleted = checkpoint(_count_by(ids.select("collection").unionAll(documents.select("collection")), "chunks_deleted"))
    store.delete_ids(ids)
    store.delete_documents(documents)
    store.compact()
    gate = failed.select("collection", F.concat(
        F.lit("orphan_cleanup: skipped (destructive step gated by "), F.col("n"), F.lit(" prior error(s))")).alias("error"))
    return deleted, checkpoint(gate)


def result_rows(
    collections: DataFrame, documents: DataFrame, diff: DataFrame, stored: list[DataFrame], deleted: DataFrame, problems: DataFrame
) -> DataFrame:
    skipped = diff.groupBy("collection").agg(F.sum(F.when(F.col("status") == changes.UNCHANGED, F.col("copies")).otherwise(0)).alias("chunks_skipped"))
    parts = [
        _count_by(documents, "documents_processed"), _count_by(reduce(DataFrame.unionAll, stored), "chunks_stored"), skipped, deleted,
        _count_by(problems, "error_count"),
    ]
    joined = reduce(lambda a, b: a.join(b, "collection", "left"), parts, collections)
    names = ["documents_processed", "chunks_stored", "chunks_skipped", "chunks_deleted", "error_count"]
    counted = joined.select("collection", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return checkpoint(counted.withColumn("success", F.col("error_count") == 0))


def empty_collection(store: KnowledgeStore, collection: str) -> int:
    """Clean-up for a source that now gives no documents: every chunked document goes.

    Rows that belong to no chunked document, the overview among them, stay.
    """
    held = store.read([collection])
    gone = held.filter(F.col("metadata.embeddingType") == "chunk").select(
        "collection", F.col("metadata.documentId").alias("document_id")
    ).filter("document_id <> ''").distinct()
    gone = checkpoint(gone)
    store.delete_documents(gone)
    return gone.count()


def website_documents(pages: DataFrame) -> DataFrame:
    """(base_url, url, html, rank) of crawled pages -> documents, one collection per site."""
    texts = checkpoint(
        pages.select(
            "base_url", urls.website_collection(F.col("base_url")).alias("site"), F.col("url").alias("page_id"), "rank",
            html.extract_text("html").alias("content"), html.extract_title("html").alias("title"),
        ).filter(~is_blank(F.col("content")))
    )
    cleaned = without_boilerplate(texts.select("site", "page_id", "content"))
    about = texts.groupBy("site", "page_id").agg(F.min("rank").alias("position"), F.min_by("title", "rank").alias("title"))
    return cleaned.join(about, ["site", "page_id"]).select(
        F.col("site").alias("collection"), F.col("page_id").alias("document_id"), F.col("page_id").alias("source"),
        F.lit("knowledge").alias("type"), "title", F.lit(None).cast("string").alias("uri"), "content",
        F.col("position").cast("long").alias("position"),
    )


def numbered_tree_documents(documents: DataFrame) -> DataFrame:
    """Tree documents with the numeric position that the later stages order by."""
    return sorted_positions(documents, "collection", "path").select(*DOCUMENT_COLUMNS)


def website_result(outcome: IngestOutcome, type_: str, purpose: str, persona_id: str) -> DataFrame:
    """Outbound result events of a site ingest."""
    messages = outcome.errors.groupBy("collection").agg(F.array_join(F.array_sort(F.collect_list("error")), "; ").alias("error"))
    return outcome.results.join(messages, "collection", "left").select(
        "collection", F.lit("").alias("bodyOfKnowledgeId"), F.lit(type_).alias("type"), F.lit(purpose).alias("purpose"),
        F.lit(persona_id).alias("personaId"), F.unix_millis(F.current_timestamp()).alias("timestamp"),
        F.when(F.col("success"), "success").otherwise("failure").alias("result"), F.coalesce("error", F.lit("")).alias("error"),
    )
