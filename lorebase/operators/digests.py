"""Digest trees: what a corpus state holds, as hashes of chunks, documents, ranges and collections.

The digest of a document is the exclusive or of its distinct chunk addresses; a range is the
documents whose name's md5 begins with the range's hexadecimal digits, and its digest that of
the hashes of its parts with their names. The root of a collection is the range of no digits.
So all levels are sums with map-side combining, in any order, and a state's digests are one
narrow table, partitioned by level and, for documents, by the first digit of their range.

Two states are compared from the roots downwards: below a range with equal digests nothing is
read. At every level the table of differing ranges is written, measured and met by the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.session import broadcast_measured, checkpoint, scratch_folder

#: Hexadecimal digits of the levels of ranges; documents lie below the last.
LEVELS = (0, 2, 4)
DOCUMENTS = -1
#: A digest is four numbers of 15 hexadecimal digits each.
LANES, DIGITS = 4, 15
ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def _lanes(hash_: Column) -> list[Column]:
    return [F.conv(F.substring(hash_, DIGITS * i + 1, DIGITS), 16, 10).cast("bigint") for i in range(LANES)]


def _digest(hash_: Column) -> Column:
    joined = F.concat(*[F.lpad(F.hex(F.bit_xor(lane)), DIGITS, "0") for lane in _lanes(hash_)])
    return F.lower(joined).alias("digest")


def _named(name: str) -> Column:
    return F.sha2(F.concat(F.col(name), F.lit("|"), F.col("digest")), 256)


def document_digests(addresses: DataFrame) -> DataFrame:
    """collection, document_id, digest of (collection, document_id, id: a sha256 in hexadecimal digits), repeats of which count once."""
    return addresses.distinct().groupBy("collection", "document_id").agg(_digest(F.col("id")))


def digest_tree(spark: SparkSession, addresses: DataFrame) -> DataFrame:
    """The written digests of a state: collection, node, parent, digest, level and first (the partitions)."""
    path = scratch_folder(spark, "digests")
    hashed = F.md5("document_id")
    documents = document_digests(addresses).select(
        "collection", F.col("document_id").alias("node"), F.substring(hashed, 1, LEVELS[-1]).alias("parent"), "digest",
        F.lit(DOCUMENTS).alias("level"), F.substring(hashed, 1, 1).alias("first"),
    )
    order = ["level", "first", "collection", "parent", "node"]
    documents.repartition("level", "first").sortWithinPartitions(*order).write.partitionBy("level", "first").parquet(path)
    schema = "collection string, node string, parent string, digest string, level int, first string"
    below, level = spark.read.schema(schema).parquet(path), DOCUMENTS
    for digits, above in zip(reversed(LEVELS), [*reversed(LEVELS[:-1]), None], strict=True):
        part = spark.read.schema(schema).parquet(path).filter(F.col("level") == level) if level != DOCUMENTS else below
        up = part.groupBy("collection", F.col("parent").alias("node")).agg(_digest(_named("node")))
        parent = F.lit("") if above is None else F.substring("node", 1, above)
        up.select("collection", "node", parent.alias("parent"), "digest", F.lit(digits).alias("level"), F.lit("-").alias("first")).write.mode(
            "append").partitionBy("level", "first").parquet(path)
        level = digits
    return spark.read.schema(schema).parquet(path)


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """collection, node, kind where the digests of two states differ or only one has any."""
    sides = a.select("collection", "node", F.col("digest").alias("_a")).join(b.select("collection", "node", F.col("digest").alias("_b")), ["collection", "node"], "full")
    kind = F.when(F.col("_a").isNull(), ADDED).when(F.col("_b").isNull(), REMOVED).otherwise(CHANGED)
    return sides.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("collection", "node", kind.alias("kind"))


def differing_roots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Collections whose roots differ: the only rows read are one a collection."""
    return _differing(*[t.filter(F.col("level") == LEVELS[0]) for t in (before, after)]).select("collection", "kind")


def differing_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """collection, document_id, kind (added, removed, changed), found by opening only ranges that differ."""
    trees, open_ = (before, after), None
    for level in (*LEVELS, DOCUMENTS):
        parts = [t.filter(F.col("level") == level) for t in trees]
        if open_ is not None:
            if level == DOCUMENTS:  # sixteen first digits at most: partitions without a differing range are not listed
                firsts = [r[0] for r in open_.select(F.substring("parent", 1, 1)).distinct().collect()]
                parts = [p.filter(F.col("first").isin(firsts)) for p in parts]
            known = broadcast_measured(open_, 64)
            parts = [p.join(known, ["collection", "parent"], "left_semi") for p in parts]
        found = _differing(*parts)
        if level == DOCUMENTS:
            return found.withColumnRenamed("node", "document_id")
        open_ = checkpoint(found.select("collection", F.col("node").alias("parent")))
    raise AssertionError


def overview_due(before: DataFrame, after: DataFrame, unlisted: DataFrame, existing: DataFrame) -> DataFrame:
    """collection, root_differs, documents_differ, has_overview, skip of every collection of the later state.

    ``unlisted`` (collection, document_id) are documents that are still listed but give no
    chunks: those are neither removed nor changed. ``existing`` has the collections with an
    overview. A collection is skipped if it has one and no document differs.
    """
    roots = differing_roots(before, after).select("collection", F.lit(True).alias("root_differs"))
    documents = differing_documents(before, after).join(unlisted, ["collection", "document_id"], "left_anti")
    counts = documents.groupBy("collection").agg(F.count("*").alias("documents_differ"))
    every = after.filter(F.col("level") == LEVELS[0]).select("collection")
    have = existing.select("collection").distinct().withColumn("has_overview", F.lit(True))
    joined = every.join(roots, "collection", "left").join(counts, "collection", "left").join(have, "collection", "left")
    filled = joined.select(
        "collection", F.coalesce("root_differs", F.lit(False)).alias("root_differs"), F.coalesce("documents_differ", F.lit(0)).alias("documents_differ"),
        F.coalesce("has_overview", F.lit(False)).alias("has_overview"),
    )
    return filled.withColumn("skip", F.col("has_overview") & (F.col("documents_differ") == 0))
