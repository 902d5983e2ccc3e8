"""Digest trees of the two corpus states, and what they decide about overviews.

Here a collection is a language and source, so that some collections stay as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.hashing import chunk_hash
from lorebase.operators import digests
from lorebase.operators.summaries import overview_rows
from lorebase.plans.corpus import EARLIER_SQL, LATER_SQL, chunks_sql, content_vector, earlier_documents, knowledge_store, later_documents, windows
from lorebase.session import materialised
from lorebase.sources.store import KnowledgeStore, store_rows


def _by_source(documents: DataFrame) -> DataFrame:
    return documents.withColumn("collection", F.concat_ws("-", F.regexp_extract("collection", "^[^-]*", 0), "source"))


def _addresses(documents: DataFrame) -> DataFrame:
    """collection, document_id, id (null for a document without chunks), without texts."""
    address = chunk_hash(F.col("_c"), F.col("title"), F.col("source"), F.col("type"), F.col("document_id"))
    cut = documents.select("collection", "document_id", "title", "source", "type", F.explode_outer(windows(F.col("content"))).alias("_c"))
    return cut.select("collection", "document_id", F.when(F.col("_c").isNotNull(), address).alias("id"))


def _trees(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digests of both states, and the later documents without chunks."""
    now = materialised(_addresses(_by_source(later_documents(spark, folder))))
    before = _addresses(_by_source(earlier_documents(spark, folder))).filter(F.col("id").isNotNull())
    after = now.filter(F.col("id").isNotNull())
    return digests.digest_tree(spark, before), digests.digest_tree(spark, after), now.filter(F.col("id").isNull()).select("collection", "document_id")


def digest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that differ between the states, found from the roots downwards."""
    before, after, unlisted = _trees(spark, folder)
    return digests.differing_documents(before, after).join(unlisted, ["collection", "document_id"], "left_anti")


_SOURCE = "regexp_extract(collection, '^[^-]*') || '-' || source AS collection"
_STATES_SQL = f"""
WITH {EARLIER_SQL}, {LATER_SQL}, e AS (SELECT * REPLACE ({_SOURCE}) FROM earlier), l AS (SELECT * REPLACE ({_SOURCE}) FROM later),
{chunks_sql('old', 'e')}, {chunks_sql('now', 'l')},
a AS (SELECT collection, document_id, list(DISTINCT content_hash ORDER BY content_hash) AS ids FROM old GROUP BY ALL),
b AS (SELECT collection, document_id, list(DISTINCT content_hash ORDER BY content_hash) AS ids FROM now GROUP BY ALL),
differing AS (
  SELECT collection, document_id, CASE WHEN a.ids IS NULL THEN 'added' WHEN b.ids IS NULL THEN 'removed' ELSE 'changed' END AS kind
  FROM a FULL JOIN b USING (collection, document_id)
  WHERE a.ids IS DISTINCT FROM b.ids
    AND NOT (b.ids IS NULL AND (collection, document_id) IN (SELECT (collection, document_id) FROM l)))"""
DIGEST_CHANGES_SQL = f"{_STATES_SQL} SELECT * FROM differing"


def _store_with_overviews(spark: SparkSession, folder: str) -> KnowledgeStore:
    """A store that got an overview for every collection of several documents."""
    counted = _by_source(earlier_documents(spark, folder)).groupBy("collection").agg(F.count("*").alias("n"))
    texts = counted.filter("n > 1").select("collection", F.concat(F.lit("Overview of "), F.col("n"), F.lit(" documents")).alias("summary"))
    rows = overview_rows(texts)
    return knowledge_store(spark, store_rows(rows.withColumn("embedding", content_vector(F.col("content")))))


def overview_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the corpus's collections the store holds an overview of, by a look-up of its row."""
    stored = _store_with_overviews(spark, folder).get(None, where={"documentId": fixed.OVERVIEW_DOC_ID}, include=["document"])
    every = _by_source(earlier_documents(spark, folder)).select("collection").distinct()
    return every.join(stored, "collection", "left").select("collection", F.col("id").isNotNull().alias("has_overview"), F.col("document").alias("overview"))


_OVERVIEWS_SQL = "o AS (SELECT collection, 'Overview of ' || count(*) || ' documents' AS overview FROM e GROUP BY 1 HAVING count(*) > 1)"
OVERVIEW_EXISTS_SQL = f"""{_STATES_SQL}, {_OVERVIEWS_SQL}
SELECT collection, overview IS NOT NULL AS has_overview, overview FROM (SELECT DISTINCT collection FROM e) LEFT JOIN o USING (collection)"""


def overview_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Collections whose overview is skipped: it exists, and no document changed or went."""
    before, after, unlisted = _trees(spark, folder)
    existing = _store_with_overviews(spark, folder).get(None, where={"documentId": fixed.OVERVIEW_DOC_ID}, include=[])
    return digests.overview_due(before, after, unlisted, existing)


OVERVIEW_DECISIONS_SQL = f"""{_STATES_SQL}, {_OVERVIEWS_SQL},
whole AS (
  SELECT collection, a.x IS DISTINCT FROM b.x AS root_differs
  FROM (SELECT collection, list(content_hash ORDER BY document_id, content_hash) AS x FROM (SELECT DISTINCT collection, document_id, content_hash FROM old) GROUP BY 1) a
  RIGHT JOIN (SELECT collection, list(content_hash ORDER BY document_id, content_hash) AS x FROM (SELECT DISTINCT collection, document_id, content_hash FROM now) GROUP BY 1) b USING (collection)),
n AS (SELECT collection, count(*) AS n FROM differing GROUP BY 1)
SELECT collection, root_differs, coalesce(n, 0) AS documents_differ, overview IS NOT NULL AS has_overview, overview IS NOT NULL AND n IS NULL AS skip
FROM whole LEFT JOIN n USING (collection) LEFT JOIN o USING (collection)"""

QUERIES = {
    "digest_changes": (digest_changes, DIGEST_CHANGES_SQL),
    "overview_exists": (overview_exists, OVERVIEW_EXISTS_SQL),
    "overview_decisions": (overview_decisions, OVERVIEW_DECISIONS_SQL),
}
