"""Splitting texts into pre-tokens, and small batches of texts out of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

#: Texts handled together in a task, in characters, so that a batch's pre-tokens stay small.
CHUNK_CHARS = 1 << 20
#: Entries of a worker's memory of pre-tokens; it is emptied when full.
MEMORY = 300_000


@lru_cache(maxsize=4)
def splitter(pattern: str):
    import regex

    # \s means the Unicode property here, as in the libraries: no separators 1C to 1F.
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def chunks(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of the batch in pieces of limited size; null texts are empty."""
    texts, first, size = [], 0, 0
    for row in range(batch.num_rows):
        text = batch.column(column)[row].as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield first, texts
            texts, first, size = [], row + 1, 0
    if texts:
        yield first, texts
