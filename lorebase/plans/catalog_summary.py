"""Summaries, sections, packing and the corpus overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.models import ModelPorts
from lorebase.operators import changes
from lorebase.operators.packing import assign_groups
from lorebase.operators.summaries import call_plan, document_summaries, join_only, overview, refine, sections
from lorebase.plans.corpus import EARLIER_SQL, chunks_sql, earlier_documents, hashed_chunks
from lorebase.session import checkpoint, materialised

PORTS = ModelPorts()
CONCAT = ModelPorts(reduce_text=join_only)
LENGTH, FANIN = 2000, fixed.SUMMARY_FANIN
WS = fixed.WS_RE2
SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


def _summaries(spark: SparkSession, folder: str, ports: ModelPorts) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = earlier_documents(spark, folder)
    chunks = materialised(hashed_chunks(documents))  # counted, mapped and joined; cut and hashed once
    wanted = changes.summary_candidates(chunks, None)
    return documents, chunks, document_summaries(chunks, wanted, ports, max_length=LENGTH)


def map_reduce_digest(spark: SparkSession, folder: str) -> DataFrame:
    return _summaries(spark, folder, PORTS)[2]


def map_reduce_concat(spark: SparkSession, folder: str) -> DataFrame:
    """Every merge falls back to joining its inputs, as when the reduce model is down."""
    return _summaries(spark, folder, CONCAT)[2]


def digest_sql(name: str, source: str) -> str:
    """``source`` (key, ix, text, budget) -> ``name`` (key, ix, text): the digest stand-in."""
    return f"""
{name}_w AS (
  SELECT key, ix, generate_subscripts(ws, 1) AS p, unnest(ws) AS w
  FROM (SELECT key, ix, regexp_split_to_array(text, '{WS}+') AS ws FROM {source} WHERE length(text) > budget)),
{name}_g AS (SELECT key, ix, w, min(p) AS f, count(*) AS c, any_value(budget) AS budget
             FROM {name}_w JOIN {source} USING (key, ix) WHERE w <> '' GROUP BY key, ix, w),
{name}_r AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY key, ix ORDER BY c DESC, f) AS upto FROM {name}_g),
{name}_k AS (SELECT key, ix, string_agg(w, ' ' ORDER BY f) AS text FROM {name}_r WHERE upto <= budget + 1 GROUP BY key, ix),
{name} AS (
  SELECT s.key, s.ix, CASE WHEN length(s.text) <= s.budget THEN s.text ELSE coalesce(k.text, '') END AS text
  FROM {source} s LEFT JOIN {name}_k k USING (key, ix))"""


def level_sql(name: str, source: str, merge: bool = True) -> str:
    """One reduce level over ``source`` (key, ix, text)."""
    joined = f"""
{name}_j AS (SELECT key, ix // {FANIN} AS ix, count(*) AS n, string_agg(text, {SEP} ORDER BY ix) AS text,
             CASE WHEN count(*) > 1 THEN {LENGTH} ELSE 1000000000 END AS budget FROM {source} GROUP BY key, ix // {FANIN})"""
    if merge:
        return f"{joined}, {digest_sql(name, f'{name}_j')}"
    return f"{joined}, {name} AS (SELECT key, ix, text FROM {name}_j)"


def mapped_sql(name: str, source: str) -> str:
    """``source`` (key, ix, text) -> mapped, non-empty, renumbered ``name``."""
    budget = f"CASE WHEN n = 1 THEN {LENGTH} ELSE greatest({fixed.MAP_FLOOR_CHARS}, {LENGTH} // greatest(2, n)) END"
    return f"""
{name}_b AS (SELECT *, {budget} AS budget FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {source})),
{digest_sql(f'{name}_m', f'{name}_b')},
{name} AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ix) - 1 AS ix, text FROM {name}_m WHERE text <> '')"""


_SUMMARY_BASE = f"""
WITH {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')},
wanted AS (SELECT document_id AS key FROM chunks GROUP BY 1 HAVING count(*) >= {fixed.SUMMARY_MIN_CHUNKS}),
chosen AS (SELECT document_id AS key, chunk_index AS ix, content AS text FROM chunks WHERE document_id IN (SELECT key FROM wanted)),
{mapped_sql('mapped', 'chosen')}"""
_DIGESTED = f"{_SUMMARY_BASE}, {level_sql('l1', 'mapped')}, {level_sql('l2', 'l1')}, {level_sql('summary', 'l2')}"
_CONCATENATED = f"{_SUMMARY_BASE}, summary AS (SELECT key, string_agg(text, {SEP} ORDER BY ix) AS text FROM mapped GROUP BY key)"
_SUMMARY_SELECT = """
SELECT e.collection, e.document_id, s.text AS summary FROM summary s JOIN earlier e ON e.document_id = s.key"""


REFINE_LENGTH = 200


def refine_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A running summary over the chunks of every document, in order: the last characters that fit the growing budget."""
    chunks = hashed_chunks(earlier_documents(spark, folder))
    return refine(chunks, "document_id", "chunk_index", "content", lambda summary, chunk, budget: f"{summary}|{chunk[:50]}"[-budget:], REFINE_LENGTH)


REFINE_FOLD_SQL = f"""
WITH RECURSIVE {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')},
c AS (SELECT document_id, chunk_index AS ix, content, count(*) OVER (PARTITION BY document_id) AS n FROM chunks),
budgeted AS (
  SELECT *, CAST(trunc({REFINE_LENGTH} * (0.4::DOUBLE + 0.6::DOUBLE * CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE ix::DOUBLE / (n - 1)::DOUBLE END)) AS BIGINT) AS budget FROM c),
fold AS (
  SELECT document_id, ix, n, right('|' || left(content, 50), budget) AS summary FROM budgeted WHERE ix = 0
  UNION ALL
  SELECT f.document_id, b.ix, f.n, right(f.summary || '|' || left(b.content, 50), b.budget) FROM fold f JOIN budgeted b ON b.document_id = f.document_id AND b.ix = f.ix + 1)
SELECT document_id, summary FROM fold WHERE ix = n - 1"""


def map_reduce_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Reduce calls per level and document, for the fan-in of 3 that small documents show levels with."""
    return call_plan(hashed_chunks(earlier_documents(spark, folder)), ["collection", "document_id"], 3)


MAP_REDUCE_PLAN_SQL = f"""
WITH RECURSIVE {EARLIER_SQL}, {chunks_sql('chunks', 'earlier')},
p(collection, document_id, level, n_in) AS (
  SELECT collection, document_id, 1, count(*) FROM chunks GROUP BY collection, document_id
  UNION ALL
  SELECT collection, document_id, level + 1, CAST(ceil(n_in / 3.0) AS BIGINT) FROM p WHERE n_in > 1)
SELECT collection, document_id, CAST(level AS INTEGER) AS level, n_in,
       n_in // 3 + CASE WHEN n_in % 3 >= 2 THEN 1 ELSE 0 END AS calls, CAST(ceil(n_in / 3.0) AS BIGINT) AS n_out
FROM p WHERE n_in > 1"""


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    documents, chunks, summaries = _summaries(spark, folder, PORTS)
    return sections(documents, chunks, summaries)


def bok_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _sections(spark, folder).select("collection", "document_id", "order_key", "text")


_SECTIONS = f"""{_DIGESTED},
sections AS (
  SELECT e.collection, e.document_id, e.position AS order_key, coalesce(s.text, raw) AS text
  FROM earlier e JOIN (SELECT document_id, string_agg(content, chr(10) ORDER BY chunk_index) AS raw FROM chunks GROUP BY 1) r
    USING (document_id) LEFT JOIN summary s ON s.key = e.document_id)"""
BOK_SECTIONS_SQL = f"{_SECTIONS} SELECT collection, document_id, order_key, text FROM sections"


def bok_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy groups of whole documents per collection."""
    docs = earlier_documents(spark, folder).select("collection", F.col("position").alias("order_key"), F.col("content").alias("text"))
    return assign_groups(docs)


def packing_sql(source: str, name: str) -> str:
    """``source`` (collection, order_key, text) -> ``name`` (collection, order_key, group_no) by the plain loop."""
    limit = fixed.SECTION_GROUP_CHARS
    return f"""
{name}_n AS (SELECT collection, order_key, length(text) AS n, row_number() OVER (PARTITION BY collection ORDER BY order_key) AS i FROM {source}),
{name}_l(collection, i, order_key, size, group_no) AS (
  SELECT collection, i, order_key, CAST(n AS BIGINT), CAST(0 AS BIGINT) FROM {name}_n WHERE i = 1
  UNION ALL
  SELECT s.collection, s.i, s.order_key, CASE WHEN l.size + s.n > {limit} THEN s.n ELSE l.size + s.n END,
         l.group_no + CASE WHEN l.size + s.n > {limit} THEN 1 ELSE 0 END
  FROM {name}_l l JOIN {name}_n s ON s.collection = l.collection AND s.i = l.i + 1),
{name} AS (SELECT collection, order_key, group_no FROM {name}_l)"""


BOK_PACKING_SQL = f"""
WITH RECURSIVE {EARLIER_SQL}, docs AS (SELECT collection, position AS order_key, content AS text FROM earlier),
{packing_sql('docs', 'packed')}
SELECT collection, order_key, group_no FROM packed"""


def bok_rounds_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Map calls per collection with and without packing."""
    return bok_packing(spark, folder).groupBy("collection").agg(
        F.count("*").alias("sections"), (F.max("group_no") + 1).alias("rounds")
    )


BOK_ROUNDS_SQL = f"""
WITH RECURSIVE {EARLIER_SQL}, docs AS (SELECT collection, position AS order_key, content AS text FROM earlier),
{packing_sql('docs', 'packed')}
SELECT collection, count(*) AS sections, max(group_no) + 1 AS rounds FROM packed GROUP BY 1"""


def bok_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The overview of every collection: sections, packing, map and tree-reduce."""
    return overview(materialised(_sections(spark, folder)), PORTS, max_length=LENGTH, materialise=checkpoint)


BOK_OVERVIEW_SQL = f"""{_SECTIONS.replace('WITH ', 'WITH RECURSIVE ', 1)},
{packing_sql('sections', 'packed')},
grouped AS (SELECT collection AS key, group_no AS ix, string_agg(text, {SEP} ORDER BY order_key) AS text
            FROM sections JOIN packed USING (collection, order_key) GROUP BY collection, group_no),
{mapped_sql('om', 'grouped')}, {level_sql('o1', 'om')}, {level_sql('o2', 'o1')}, {level_sql('o3', 'o2')}
SELECT key AS collection, text AS summary FROM o3"""


QUERIES = {
    "map_reduce_digest": (map_reduce_digest, _DIGESTED + _SUMMARY_SELECT),
    "map_reduce_concat": (map_reduce_concat, _CONCATENATED + _SUMMARY_SELECT),
    "refine_fold": (refine_fold, REFINE_FOLD_SQL),
    "map_reduce_plan": (map_reduce_plan, MAP_REDUCE_PLAN_SQL),
    "bok_sections": (bok_sections, BOK_SECTIONS_SQL),
    "bok_packing": (bok_packing, BOK_PACKING_SQL),
    "bok_rounds_saved": (bok_rounds_saved, BOK_ROUNDS_SQL),
    "bok_overview": (bok_overview, BOK_OVERVIEW_SQL),
}
