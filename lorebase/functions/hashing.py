"""Content addresses: chunk ids, storage ids, duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.text import folded


def content_key(col: Column) -> Column:
    """Whitespace- and case-insensitive key of a text."""
    return F.sha2(folded(col), 256)


def chunk_hash(content: Column, title: Column, source: Column, kind: Column, document_id: Column) -> Column:
    """Address of a chunk; NUL keeps field boundaries, and nulls count as empty fields."""
    fields = [F.coalesce(c, F.lit("")) for c in (content, title, source, kind, document_id)]
    return F.sha2(F.concat_ws("\0", *fields), 256)


def storage_id(embedding_type: Column, content_hash: Column, document_id: Column, chunk_index: Column) -> Column:
    addressed = (embedding_type == "chunk") & (F.coalesce(content_hash, F.lit("")) != "")
    return F.when(addressed, content_hash).otherwise(F.concat_ws("-", document_id, chunk_index))
