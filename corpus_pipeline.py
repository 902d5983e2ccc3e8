"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns what its operator keeps; ``run`` writes
every stage's rows as Parquet to the shared folder and reads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import line_dedup, mixing, near_sets, piece_codec, quality, queries
from lorebase.llm.common import BROADCAST_BYTES, written
from lorebase.session import ship_package
from lorebase.sources.tables import table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose (doc_id, text) is not among ``gone``, columns _id and _hash. Rows that agree in both share their fate."""
    gone = written(gone, "rejected")
    if gone.count() * 32 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    return docs.join(gone, same, "left_anti")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).alias("doc_id"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    A null text has no words and is rejected; repeated rows share their verdict. Other columns
    pass through. An empty table stays empty.
    """
    columns = docs.columns
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), keep=columns)
    return judged.filter("kept").select(*[F.col(f"row.`{c}`") for c in columns])


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars, if there is such a column, follows the text.

    No row goes: a document of which every line recurs keeps an empty text, a null text stays null.
    Of lines in several documents those of the smallest doc_id stay; rows without one come last.
    """
    kept = line_dedup.drop_lines(docs, linked=True)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id (and, between those, of smallest text hash) of each component of five-word shingle sets at a similarity of 0.8 or more stays.

    Texts without words, nulls among them, are one group. Rows that agree in doc_id and text
    stay or go together.
    """
    ship_package(spark)
    found = near_sets.near_sets(_keyed(docs))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id._id", "doc_id._hash")
    return _without(docs, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mixture's budgets; one that two epochs take comes twice.

    Null levels are a leaf of their own, texts without words cost nothing, repeated rows come or
    stay together.
    """
    return mixing.mix(docs, queries.mix_levels(), **queries.MIX).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it. A null text counts as empty, with no ids; rows stay as they are."""
    import public_tokenizers

    ship_package(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")  # in place of the text, on the way back
    decoded = piece_codec.encode_and_decode(docs.select("doc_id", "lang", "source", "text", digest), ranks, public_tokenizers.PATTERN, keep=False)
    same = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_recurring_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: SQL cannot express the SimHash, the hashed n-gram and the encoding stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
