"""Text, hashing, chunking and duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions import text as tx
from lorebase.functions.hashing import content_key
from lorebase.functions.splitting import recursive_chunks
from lorebase.operators.boilerplate import boilerplate_keys, without_boilerplate
from lorebase.operators.dedup import first_seen, keep_first, keep_last
from lorebase.operators.ordering import batch_number
from lorebase.plans.corpus import (
    EARLIER_SQL, chunks_sql, earlier_documents, hashed_chunks, single_spaced_sql,
)
from lorebase.sources.tables import table

WS = fixed.WS_RE2
LINE_SHARE = 0.02  # the given documents repeat lines, not paragraphs, and rarely on half of a source


def _strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def _tidy_sql(column: str) -> str:
    collapsed = f"regexp_replace({column}, '[ \\t]+', ' ', 'g')"
    return _strip_sql(f"regexp_replace({collapsed}, '\\n[ \\t]*\\n[ \\t]*\\n+', chr(10) || chr(10), 'g')")


# Name, text, and whether the entity counts without its semicolon; & has to come last.
ENTITIES = (
    ("lt", "<", True), ("gt", ">", True), ("quot", '"', True), ("#39", "'", True), ("copy", "©", True), ("middot", "·", True),
    ("nbsp", "\xa0", True), ("mdash", "—", False), ("ndash", "–", False), ("hellip", "…", False), ("amp", "&", True),
)


def _unescape_sql(column: str) -> str:
    for name, char, bare in ENTITIES:
        quoted = char.replace("'", "''")
        column = f"regexp_replace({column}, '&{name};{'?' if bare else ''}', '{quoted}', 'g')"
    return column


def strip_html_sql(column: str) -> str:
    no_blocks = f"regexp_replace({column}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
    lines = f"regexp_replace({no_blocks}, '(?i)</?(br|p|div|li|tr|h[1-6]|hr|blockquote|pre)(\\s[^>]*)?/?>', chr(10), 'g')"
    bare = f"regexp_replace({lines}, '<[^>]+>', '', 'g')"
    return _tidy_sql(_unescape_sql(bare))


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    chunks = hashed_chunks(earlier_documents(spark, folder))
    return chunks.select("document_id", "chunk_index", "content_hash")


CONTENT_HASH_SQL = f"""WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')}
SELECT document_id, chunk_index, content_hash FROM chunks"""


def chunk_window(spark: SparkSession, folder: str) -> DataFrame:
    chunks = hashed_chunks(earlier_documents(spark, folder))
    return chunks.select("document_id", "chunk_index", "content", "embedding_type")


CHUNK_WINDOW_SQL = f"""WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')}
SELECT document_id, chunk_index, content, 'chunk' AS embedding_type FROM chunks"""


def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    return recursive_chunks(docs, *fixed.WEBSITE_CHUNK)


def content_key_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", content_key(F.col("text")).alias("key"))
    return keep_first(docs, ["key"], "doc_id").select("doc_id", "key")


_KEY_SQL = f"sha256(lower({single_spaced_sql('text')}))"
CONTENT_KEY_DEDUP_SQL = f"SELECT min(doc_id) AS doc_id, {_KEY_SQL} AS key FROM documents GROUP BY 2"


def store_dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", content_key(F.col("text")).alias("key"))
    return keep_last(docs, ["key"], "doc_id").select("doc_id", "key")


STORE_DEDUP_LAST_SQL = f"SELECT max(doc_id) AS doc_id, {_KEY_SQL} AS key FROM documents GROUP BY 2"


def first_seen_documents(spark: SparkSession, folder: str) -> DataFrame:
    chunks = hashed_chunks(earlier_documents(spark, folder)).filter(F.col("embedding_type") != "summary")
    return first_seen(chunks, ["collection", "document_id"], "position")


FIRST_SEEN_SQL = f"""WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')}
SELECT collection, document_id, min(position) AS position FROM chunks GROUP BY ALL"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("source").alias("site"), F.col("doc_id").alias("page_id"), F.col("text").alias("content")
    )


def boilerplate_key_query(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate_keys(_lines(spark, folder), threshold=LINE_SHARE, separator="\n")


_BOILER_SQL = f"""
WITH p AS (
  SELECT source AS site, doc_id AS page_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS paragraph
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents)),
k AS (SELECT *, lower({single_spaced_sql('paragraph')}) AS key FROM p),
sizes AS (SELECT source AS site, count(*) AS site_pages FROM documents GROUP BY 1),
b AS (
  SELECT k.site, key, count(DISTINCT page_id) AS n_pages FROM k JOIN sizes USING (site)
  WHERE length(key) >= {fixed.MIN_BOILERPLATE_KEY} AND site_pages >= {fixed.BOILERPLATE_MIN_PAGES}
  GROUP BY k.site, key, site_pages HAVING count(DISTINCT page_id) > {LINE_SHARE} * site_pages)"""
BOILERPLATE_KEYS_SQL = f"{_BOILER_SQL} SELECT site, key, n_pages FROM b"


def cross_page_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    return without_boilerplate(_lines(spark, folder), threshold=LINE_SHARE, separator="\n")


CROSS_PAGE_SQL = f"""{_BOILER_SQL},
kept AS (
  SELECT site, page_id, string_agg(paragraph, chr(10) ORDER BY pos) AS content
  FROM k WHERE (site, key) NOT IN (SELECT (site, key) FROM b) GROUP BY site, page_id)
SELECT * FROM kept WHERE length({_strip_sql('content')}) > 0"""


def html_strip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", tx.strip_html(F.col("html")).alias("content"))


HTML_STRIP_SQL = f"SELECT page_id, {strip_html_sql('html')} AS content FROM pages"


def citations_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with citation marks put behind every sentence, and the marks taken out again."""
    cited = F.regexp_replace("text", r"\.", ".【4:0†source】")
    return table(spark, folder, "documents").select("doc_id", tx.strip_citations(cited).alias("content"))


CITATIONS_SQL = f"""
SELECT doc_id, {_strip_sql("regexp_replace(replace(text, '.', '.【4:0†source】'), '【[^】]*】', '', 'g')")} AS content
FROM documents"""


def link_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", tx.tidy(F.col("html")).alias("content"))


LINK_NORMALISE_SQL = f"SELECT page_id, {_tidy_sql('html')} AS content FROM pages"


def run_label(spark: SparkSession, folder: str) -> DataFrame:
    """Run ids from the event times, labelled with the event's type and payload."""
    events = table(spark, folder, "events")
    label = F.concat_ws(" ", "event_type", "props")
    return events.select("event_id", tx.run_id(F.col("ts"), label).alias("run_id"), tx.run_id(F.col("ts"), F.lit(None)).alias("bare_id"))


RUN_LABEL_SQL = r"""
SELECT event_id,
       strftime(ts, '%Y%m%dT%H%M%S') || '_' || regexp_replace(regexp_replace(event_type || ' ' || props, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS run_id,
       strftime(ts, '%Y%m%dT%H%M%S') AS bare_id
FROM events"""


def mask_secret(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return customers.select(
        "c_custkey",
        tx.mask_secret(F.lit("llm_api_key"), F.col("c_name")).alias("secret"),
        tx.mask_secret(F.lit("llm_api_key"), F.col("c_nationkey")).alias("short_secret"),
        tx.mask_secret(F.lit("llm_model"), F.col("c_name")).alias("plain"),
        tx.ellipsis(F.concat_ws(" ", "c_name", "c_mktsegment"), 25).alias("brief"),
    )


MASK_SECRET_SQL = """
SELECT c_custkey, CASE WHEN length(c_name) > 3 THEN left(c_name, 3) || '****' ELSE '****' END AS secret,
       CASE WHEN length(CAST(c_nationkey AS VARCHAR)) > 3 THEN left(CAST(c_nationkey AS VARCHAR), 3) || '****' ELSE '****' END AS short_secret,
       c_name AS plain,
       CASE WHEN length(c_name || ' ' || c_mktsegment) > 25 THEN left(c_name || ' ' || c_mktsegment, 25) || '...'
            ELSE c_name || ' ' || c_mktsegment END AS brief
FROM customer"""


def batch_assign(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of five documents in corpus order, without a single-task window."""
    docs = table(spark, folder, "documents").select("doc_id")
    return batch_number(docs, "doc_id", fixed.DOC_BATCH)


BATCH_ASSIGN_SQL = f"""
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {fixed.DOC_BATCH} AS BIGINT) AS batch_no FROM documents"""

QUERIES = {
    "content_hash": (content_hash, CONTENT_HASH_SQL),
    "chunk_window": (chunk_window, CHUNK_WINDOW_SQL),
    "chunk_recursive": (chunk_recursive, None),
    "content_key_dedup": (content_key_dedup, CONTENT_KEY_DEDUP_SQL),
    "store_dedup_last": (store_dedup_last, STORE_DEDUP_LAST_SQL),
    "first_seen_documents": (first_seen_documents, FIRST_SEEN_SQL),
    "boilerplate_keys": (boilerplate_key_query, BOILERPLATE_KEYS_SQL),
    "cross_page_boilerplate": (cross_page_boilerplate, CROSS_PAGE_SQL),
    "html_strip": (html_strip, HTML_STRIP_SQL),
    "link_normalise": (link_normalise, LINK_NORMALISE_SQL),
    "citations_strip": (citations_strip, CITATIONS_SQL),
    "run_label": (run_label, RUN_LABEL_SQL),
    "mask_secret": (mask_secret, MASK_SECRET_SQL),
    "batch_assign": (batch_assign, BATCH_ASSIGN_SQL),
}
