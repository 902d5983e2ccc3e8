"""Token counts of a byte-level BPE by merging ragged arrays.

The different pre-tokens of a batch of texts lie end to end in one array of symbols. In
every round each sequence's lowest-rank pair is looked up and all its occurrences in
that sequence merge at once, leftmost first where they overlap. A sequence that has no
pair left leaves the arrays with its number of symbols. Merging all occurrences at once
is what one at a time gives, because a pair that contains a merged symbol ranks higher
than the pair that made it.

A sequence of over ``LONG`` bytes takes as many rounds as ranks occur in it, so its rounds
touch only what changes: the places of every rank are kept, a round takes those of the
lowest, and looks up the pairs beside what it has merged.

Special strings inside a text are one token each, as the tokenizers library has it by
default. Nulls: a null text is empty and has no tokens. Rows without doc_id are counted
too. Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.pretokens import MEMORY, chunks, splitter

TOKEN_LIMIT = 512
NONE = np.int64(1) << 40
#: Bytes of a pre-token from which its rounds keep the places of each rank.
LONG = 1024


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merger:
    """The merge table of a tokenizers file, and counts of its pre-tokens' symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.of_byte = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        self.special = [t["content"] for t in file.get("added_tokens", []) if not t.get("normalized")]
        self.memory: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE where there is none, and the symbol it makes."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def long_symbols(self, token: bytes) -> int:
        """:meth:`symbols` of one long token."""
        symbol = self.of_byte[np.frombuffer(token, np.uint8)]
        n = len(symbol)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbours that are left; n and -1: none
        rank, made = (np.append(x, NONE) for x in self._ranks(symbol[:-1], symbol[1:]))
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            own, first = np.unique(rank[at], return_index=True)
            for r, part in zip(own.tolist(), np.split(at, first[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heappush(heap, r)
                places[r].append(part)

        if n > 1:
            note(np.arange(n))
        alive = n
        while heap:
            lowest = heappop(heap)
            at = np.unique(np.concatenate(places.pop(lowest)))
            at = at[rank[at] == lowest]
            if not len(at):
                continue
            # Of pairs side by side (one symbol repeated) every second one merges.
            run = np.append(True, right[at[:-1]] != at[1:])
            begins = np.flatnonzero(run)
            nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            at = at[nth % 2 == 0]
            gone = right[at]
            symbol[at] = made[at]
            rank[gone] = NONE
            right[at] = right[gone]
            left[right[at][right[at] < n]] = at[right[at] < n]
            alive -= len(at)
            changed = np.unique(np.concatenate((at, left[at][left[at] >= 0])))
            paired = changed[right[changed] < n]
            rank[changed] = NONE
            rank[paired], made[paired] = self._ranks(symbol[paired], symbol[right[paired]])
            note(paired)
        return alive

    def symbols(self, tokens: Sequence[bytes]) -> np.ndarray:
        """Number of symbols left of each token when no pair can merge."""
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        if long:
            result = np.empty(len(tokens), np.int64)
            rest = np.setdiff1d(np.arange(len(tokens)), long)
            result[rest] = self.symbols([tokens[i] for i in rest])
            result[long] = [self.long_symbols(tokens[i]) for i in long]
            return result
        result = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbol = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), result)
        while len(symbol) > 1:
            key = (symbol[:-1] << 20) | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)  # the last symbol has no right neighbour
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(begins, len(symbol)))
            low = np.minimum.reduceat(rank, begins)
            alive = np.repeat(low < NONE, sizes)
            result[owner[begins]] = sizes
            hit = (rank == np.repeat(low, sizes)) & (rank < NONE)
            if not hit.any():
                break
            # Of hits side by side (one symbol repeated) every second one merges.
            place = np.flatnonzero(hit)
            run = np.append(True, np.diff(place) > 1)
            nth = np.arange(len(place)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(place))))
            place = place[nth % 2 == 0]
            symbol[place] = self.made[at[place]]
            stays = alive
            stays[place + 1] = False
            symbol, owner = symbol[stays], owner[stays]
        if len(symbol) == 1:
            result[owner[0]] = 1
        return result

    def counts(self, texts: Sequence[str], pattern: str) -> list[int]:
        find, split = splitter(pattern).findall, self._pieces
        tokens = [[t for piece in split(text) for t in find(piece)] for text in texts]
        specials = [sum(text.count(s) for s in self.special) for text in texts]
        known = self.memory
        fresh = list({t for own in tokens for t in own if t not in known})
        if fresh:
            if len(known) + len(fresh) > MEMORY:
                known.clear()
                fresh = list({t for own in tokens for t in own})
            known.update(zip(fresh, self.symbols([t.encode() for t in fresh]).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, own)) + n for own, n in zip(tokens, specials, strict=True)]

    def _pieces(self, text: str) -> list[str]:
        pieces = [text]
        for special in self.special:
            pieces = [p for piece in pieces for p in piece.split(special)]
        return pieces


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. ``path`` names the file on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for _, texts in chunks(batch) for n in merger(path).counts(texts, pattern)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    counted = docs.select("doc_id", "text", n_bytes).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
