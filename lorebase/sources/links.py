"""Linked files: bodies from a folder, with the size cap, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.formats import linked_text


def read_bodies(spark: SparkSession, folder: str, max_bytes: int = fixed.MAX_LINK_BYTES) -> DataFrame:
    """(uri, body, content_type) of fetched files up to the cap; larger ones are left out.

    The cap is on the file listing, so that large files are never opened. The content
    type is unknown for files, hence the leading bytes decide the kind.
    """
    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("uri"), F.col("content").alias("body"), F.lit("").alias("content_type"))


def fetched_texts(bodies: DataFrame) -> DataFrame:
    """(uri, fetched_text) of the bodies that give text."""
    return bodies.select("uri", linked_text(F.col("body"), F.col("content_type")).alias("fetched_text")).filter(
        F.col("fetched_text").isNotNull()
    )
