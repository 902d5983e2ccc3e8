"""Splitting texts into overlapping chunks.

``recursive_chunks`` is the semantic splitter: the coarsest separator that occurs
(paragraph, line, word, character) cuts the text, pieces keep their leading
separator, neighbours are merged up to the size limit, and a chunk starts with the
tail of the one before it, at most ``overlap`` characters long. Pieces that are too
long by themselves are cut again with the next finer separator.

``window_chunks`` cuts fixed windows in generated code; it is the variant that plain
SQL can check.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function

_SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    if separator == "":
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _merge(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    window: deque[str] = deque()
    length = 0
    for piece in pieces:
        if length + len(piece) > size:
            if window:
                yield "".join(window).strip()
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.popleft())
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window).strip()


def split_text(text: str, size: int, overlap: int, level: int = 0) -> list[str]:
    """Chunks of one text, in order; blank chunks are left out."""
    while level < len(_SEPARATORS) - 1 and _SEPARATORS[level] not in text:
        level += 1
    chunks: list[str] = []
    fitting: list[str] = []
    for piece in _pieces(text, _SEPARATORS[level]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        chunks.extend(_merge(fitting, size, overlap))
        fitting = []
        if level == len(_SEPARATORS) - 1:
            chunks.append(piece)
        else:
            chunks.extend(split_text(piece, size, overlap, level + 1))
    chunks.extend(_merge(fitting, size, overlap))
    return [c for c in chunks if c]


def _splitter(size: int, overlap: int):
    @arrow_function(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return split


def _exploded(docs: DataFrame, chunks: Column) -> DataFrame:
    kept = [c for c in docs.columns if c != "content"]
    return (
        docs.select(*kept, F.posexplode(chunks).alias("chunk_index", "content"))
        .withColumn("embedding_type", F.lit("chunk"))
    )


def recursive_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """``docs`` with a ``content`` column -> one row per chunk; empty texts give none."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return _exploded(docs, _splitter(size, overlap)("content"))


def window_count(text: Column, size: int, overlap: int) -> Column:
    """Number of fixed windows of a text; an empty one has none."""
    windows = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / (size - overlap))).cast("int") + 1
    return F.when(F.length(text) > 0, windows).otherwise(0)


def window_at(text: Column, at: Column, size: int, overlap: int) -> Column:
    return F.substring(text, at * (size - overlap) + 1, F.lit(size))


def window_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Fixed windows of ``size`` every ``size - overlap`` characters."""
    text = F.col("content")
    numbers = F.sequence(F.lit(0), window_count(text, size, overlap) - 1)
    windows = F.transform(numbers, lambda i: window_at(text, i, size, overlap))
    return _exploded(docs.filter(F.length("content") > 0), windows)
