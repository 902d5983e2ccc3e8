"""Greedy packing of sections into groups of bounded size, in parallel.

Packing is sequential: where a group ends depends on where it began. A block of
consecutive sections is, however, a small function from the size of the group that is
open at its left edge to the size at its right edge and the number of groups begun.
Three steps: summarise every block on its own, walk over the block summaries of a
collection (one row per ``BLOCK_SECTIONS`` sections), number the groups inside every
block. The result equals the plain loop for every input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.text import ordered_lines
from lorebase.operators.ordering import positions

BLOCK_SECTIONS = 65_536


def _next_starts(upto: np.ndarray, limit: int) -> np.ndarray:
    """For a group begun at i: the section that begins the next one (or the length)."""
    before = np.concatenate([[0], upto[:-1]])
    first_over = np.searchsorted(upto, before + limit, side="right")
    return np.maximum(first_over, np.arange(1, len(upto) + 1))


def _summarise(limit: int):
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows.sort_values("position")["length"].to_numpy(dtype=np.int64)
        upto = np.cumsum(lengths)
        following, total = _next_starts(upto, limit), int(upto[-1])
        size_out = np.empty(len(lengths), dtype=np.int64)
        begun = np.empty(len(lengths), dtype=np.int64)
        for i in range(len(lengths) - 1, -1, -1):
            after = following[i]
            if after >= len(lengths):
                size_out[i], begun[i] = total - (upto[i] - lengths[i]), 1
            else:
                size_out[i], begun[i] = size_out[after], begun[after] + 1
        # an open group can only break where its own size first passes the limit
        reachable = np.flatnonzero((upto - lengths <= limit) & ((lengths > 0) | (np.arange(len(lengths)) == 0)))
        return pd.DataFrame({
            "collection": [key[0]], "block": [key[1]], "total": [total],
            "entry_at": [reachable.tolist()], "entry_upto": [upto[reachable].tolist()],
            "size_out": [size_out[reachable].tolist()], "begun": [begun[reachable].tolist()],
        })

    return block


def _walk(limit: int):
    def collection(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        size, groups, out = None, 0, []
        for row in blocks.sort_values("block").itertuples():
            out.append((key[0], row.block, -1 if size is None else size, groups))
            if size is None or size > limit:
                entry = 0
            else:
                entry = int(np.searchsorted(np.asarray(row.entry_upto), limit - size, side="right"))
            if entry == len(row.entry_at):
                size += row.total
            else:
                size, groups = int(row.size_out[entry]), groups + int(row.begun[entry])
        return pd.DataFrame(out, columns=["collection", "block", "open_size", "groups_before"])

    return collection


def _number(limit: int):
    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        lengths = rows["length"].to_numpy(dtype=np.int64)
        size, group = int(rows["open_size"].iloc[0]), int(rows["groups_before"].iloc[0]) - 1
        upto = np.cumsum(lengths)
        following = _next_starts(upto, limit)
        if size < 0 or size > limit:
            start = 0
        else:
            start = int(np.searchsorted(upto, limit - size, side="right"))
        numbers = np.full(len(lengths), group, dtype=np.int64)
        while start < len(lengths):
            group += 1
            end = int(following[start])
            numbers[start:end] = group
            start = end
        return pd.DataFrame({"collection": key[0], "order_key": rows["order_key"].to_numpy(), "group_no": numbers})

    return block


def assign_groups(sections: DataFrame, limit: int = fixed.SECTION_GROUP_CHARS, block_sections: int = BLOCK_SECTIONS) -> DataFrame:
    """(collection, order_key, text) -> (collection, order_key, group_no), greedily in key order.

    A group closes before the section that would take it past ``limit``; separators do
    not count; a section longer than the limit stands alone.
    """
    limit = max(fixed.SECTION_GROUP_FLOOR, limit)
    lengths = sections.select("collection", "order_key", F.length("text").cast("long").alias("length"))
    placed = positions(lengths, ["collection"], "order_key").withColumn(
        "block", F.floor(F.col("position") / block_sections)
    )
    summaries = placed.groupBy("collection", "block").applyInPandas(
        _summarise(limit),
        "collection string, block long, total long, entry_at array<long>, entry_upto array<long>, "
        "size_out array<long>, begun array<long>",
    )
    edges = summaries.groupBy("collection").applyInPandas(
        _walk(limit), "collection string, block long, open_size long, groups_before long"
    )
    return (
        placed.join(edges, ["collection", "block"])
        .groupBy("collection", "block")
        .applyInPandas(_number(limit), "collection string, order_key long, group_no long")
    )


def pack_sections(sections: DataFrame, limit: int = fixed.SECTION_GROUP_CHARS, block_sections: int = BLOCK_SECTIONS) -> DataFrame:
    """Groups of sections joined with the section separator: (collection, group_no, n_sections, text)."""
    grouped = sections.join(assign_groups(sections, limit, block_sections), ["collection", "order_key"])
    return grouped.groupBy("collection", "group_no").agg(
        F.count("*").alias("n_sections"),
        ordered_lines(F.col("order_key"), F.col("text"), fixed.SECTION_SEPARATOR).alias("text"),
    )
