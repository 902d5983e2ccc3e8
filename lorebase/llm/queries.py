"""The operators' queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import (
    exact_dedup, licenses, line_dedup, minhash, mixing, piece_codec, quality, resampling, resharding, simhash, token_count, token_store, whitening,
)
from lorebase.session import ship_package
from lorebase.sources.tables import table

SHARDS, OLD_SHARDS = 16, 20
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2}
MIX = {"weights": [{"d0": 2}, LANGUAGE_WEIGHTS, {}], "budget_share": 0.8, "max_epochs": 2, "seed": 7}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return table(spark, folder, "documents")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, folder))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, folder), _vocabulary("byte_bpe_50k.json"), _pattern())


def mix_levels() -> dict[str, Column]:
    """Domain (three groups of sources), language and source."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1), F.lit(""))
    domain = F.when(number == "", "d0").otherwise(F.concat(F.lit("d"), F.pmod(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)"), F.lit(3)).cast("string")))
    return {"domain": F.coalesce(domain, F.lit("d0")), "lang": F.col("lang"), "source": F.col("source")}


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, folder), mix_levels(), **MIX)
    return mixed.select("doc_id", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"), "_leaf.domain", F.col("_leaf.lang").alias("leaf_lang"), F.col("_leaf.source").alias("leaf_source"))


def op4_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    docs = _documents(spark, folder).select("doc_id", "text")
    return piece_codec.encode_and_decode(docs, ranks, _pattern(), keep=False).select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, folder))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_documents(spark, folder), table(spark, folder, "labels"))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, folder))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_lines(_documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op9_token_store(spark: SparkSession, folder: str) -> DataFrame:
    files = token_store.write_tokens(_documents(spark, folder), _vocabulary("word_bpe_49k.json"))
    return token_store.read_tokens(spark, files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op10_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of sources, one source in each, become sixteen of equal bytes."""
    docs = _documents(spark, folder).select("doc_id", "text", "source")
    old = F.pmod(F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)"), F.xxhash64("source")), F.lit(OLD_SHARDS))
    _, placed = resharding.reshard(docs, old, SHARDS)
    return placed.select(
        "doc_id", resharding.size_of().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, folder))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resampling.resample(_documents(spark, folder), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

LINE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM d)),
k AS (
  SELECT doc_id, pos, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w
  FROM (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS raw FROM l) WHERE len(raw) >= 5
),
leaf AS (SELECT doc_id, pos, w, {'n': len(w), 'a': w[1], 'b': w[2], 'c': w[3]} AS leaf FROM k),
mixed AS (SELECT leaf FROM leaf GROUP BY leaf HAVING count(DISTINCT w) > 1),
texts AS (SELECT DISTINCT leaf, w FROM leaf WHERE leaf IN (SELECT leaf FROM mixed)),
places AS (SELECT leaf, w, unnest(generate_series(1, len(w))) AS place, unnest(w) AS token FROM texts),
lone AS (SELECT leaf, place, token, any_value(w) AS w FROM places GROUP BY leaf, place, token HAVING count(*) = 1),
fields AS (SELECT leaf, w, list(place) AS f FROM lone GROUP BY leaf, w),
general AS (
  SELECT leaf, w, list_transform(generate_series(1, len(w)), lambda i: CASE WHEN list_contains(f, i) THEN '<*>' ELSE w[i] END) AS template
  FROM fields WHERE len(f) <= len(w) * (1 - 0.8) + 1e-9
),
named AS (SELECT doc_id, pos, coalesce(template, leaf.w) AS template FROM leaf LEFT JOIN general ON general.leaf = leaf.leaf AND general.w = leaf.w),
found AS (SELECT template, min(doc_id) AS keeper FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 2),
gone AS (SELECT DISTINCT doc_id, pos FROM named JOIN found USING (template) WHERE doc_id <> keeper),
rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_dropped, md5(text) AS text_md5 FROM rest
"""


def _share_sql(level: int) -> str:
    """CTEs that share the budgets of one level among its children."""
    names = ["domain", "lang", "source"]
    parent, own = ", ".join(names[: level - 1]) or "0", ", ".join(names[:level])
    weights = MIX["weights"][level - 1]
    weight = f"CASE {names[level - 1]} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"
    join = " AND ".join(f"c.{n} = p.{n}" for n in names[: level - 1]) or "true"
    return f"""
c{level} AS (SELECT {own}, sum(tokens) * {MIX['max_epochs']} AS cap, {weight} AS w FROM leaves GROUP BY {own}),
o{level} AS (SELECT c.*, p.budget AS pb FROM c{level} c JOIN b{level - 1} p ON {join}),
v{level} AS (SELECT *, (pb - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {names[level - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {names[level - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o{level}),
b{level} AS (SELECT {own}, least(cap, floor(w * greatest(0, max(level) OVER (PARTITION BY {parent})))::BIGINT)::BIGINT AS budget FROM v{level}),"""


MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3, 0)::VARCHAR AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda t: t <> '')) AS n FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT 0 AS z, least(floor(sum(tokens) * {MIX['budget_share']}::DOUBLE)::BIGINT, sum(tokens) * {MIX['max_epochs']})::BIGINT AS budget FROM leaves),
{_share_sql(1)}{_share_sql(2)}{_share_sql(3)}
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE {MIX['max_epochs']} END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM b3 JOIN leaves USING (domain, lang, source)),
p AS (SELECT d.*, whole, rest, md5('{MIX['seed']}|' || whole::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(text)) AS place FROM d JOIN plan USING (domain, lang, source)),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM p),
e AS (SELECT *, CASE WHEN upto <= rest AND whole < {MIX['max_epochs']} THEN whole + 1 ELSE whole END AS epochs FROM r)
SELECT doc_id, unnest(generate_series(0, epochs - 1))::BIGINT AS epoch, n AS n_tokens, domain, lang AS leaf_lang, source AS leaf_source FROM e WHERE epochs > 0
"""

QUERIES = {
    q.__name__: q
    for q in (
        op1_simhash, op2_token_counts, op3_mixing, op4_piece_codec, op5_exact_dedup,
        op6_quality, op7_licenses, op8_line_dedup, op9_token_store, op10_resharding,
        op11_whitening, op12_minhash, op13_resampling,
    )
}
CHECKS = {"op3_mixing": MIX_SQL, "op5_exact_dedup": EXACT_SQL, "op8_line_dedup": LINE_SQL}
