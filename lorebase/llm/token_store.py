"""Token ids on disk under a static range asymmetric numeral system (rANS).

The documents are range-partitioned and sorted by doc_id; each task writes segments of
about ``SEGMENT`` ids. A segment has one frequency table, counted over all its ids and
shared by its blocks. A block is coded by itself: its ids are dealt to ``LANES``
interleaved coders, which all write to one stream of 32-bit words. The segment lists its
blocks as checkpoints (byte offset, ids, words, checksum), so that any block can be
decoded alone; the table has a checksum too, and a damaged part raises an error.

File format, one Parquet row for each segment: ``part`` and ``seq`` (the order of
segments), ``n_tokens``, ``doc_ids`` and ``lengths`` (documents in order), ``table``
(zlib-compressed 32-bit frequencies of ids 0, 1, ...; they sum to 2**SCALE),
``table_crc``, ``blocks`` and ``payload``. A block in the payload is one 64-bit state for
each lane, then the words, all little-endian. Lane k of a block has the ids k, k + L,
k + 2 L and so on.

Parquet files are written by Spark's committer: a lost task leaves nothing behind.

Nulls: a null text has only the end id. Rows without doc_id come first. Rows of equal
doc_id are ordered by text; equal rows follow each other. Other columns are not read. An
empty table gives no segments. A document lies in one segment, whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import measured, shared_folder
from lorebase.llm.pretokens import chunks
from lorebase.operators.ordering import running_sum

END_ID = 2
SCALE, LANES = 18, 1024
BLOCK, SEGMENT = 1 << 18, 1 << 22
#: Entries of a worker's memory of words; a full one takes no more.
WORDS = 1_000_000
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Words(dict):
    """Ids of words; those asked for in vain are noted. ``passing`` has what a full memory could not take."""

    def __init__(self):
        super().__init__()
        self.unknown: list[bytes] = []
        self.passing: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes | None:
        found = self.passing.get(word)
        if found is None:
            self.unknown.append(word)
        return found


class Encoder:
    """Ids of texts by the tokenizers library, word by word.

    Words between ASCII white space are independent of each other under this tokenizer.
    Each different word is cut by the tokenizer's own pattern into pieces, and the library
    encodes each different piece once: the new pieces of many texts together, set apart
    by spaces and told apart by the tokens that end a piece. A word that the library's
    normaliser might change by more than lower-casing, or that may hold a special string,
    goes to it whole.
    """

    def __init__(self, path: str):
        import gc
        import json
        import os

        import regex
        from tokenizers import Tokenizer

        gc.disable()  # nothing here makes cycles, and each search for them would walk the memory of words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.find = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Printable ASCII and Latin letters that have a one-letter lower case and are composed already.
        self.simple = regex.compile("[\x21-\x7e¡-įı-ſ]+").fullmatch
        suffix = file["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in file["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.words = Words()
        self.pieces: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str] | None:
        """A word's pieces, or None if it has to go to the library whole."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if not self.simple(text) or "<|" in text:
            return None
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return [text[:-1].lower(), text[-1]]
        return self.find(text.lower())

    def _learn(self, words: set[bytes]) -> None:
        keep = self.words if len(self.words) < WORDS else self.words.passing
        pieces = self.pieces if len(self.pieces) < WORDS else {}
        cut: dict[bytes, list[str]] = {}
        for word in words:
            own = self._cut(text := word.decode())
            if own is None:
                keep[word] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                cut[word] = own
        fresh = list({p for own in cut.values() for p in own if p not in self.pieces})
        if fresh:
            ids = np.array(self.library.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            pieces.update(zip(fresh, [raw[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        for word, own in cut.items():
            keep[word] = b"".join([self.pieces[p] if p in self.pieces else pieces[p] for p in own])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        split, look = [text.encode().split() for text in texts], self.words.__getitem__
        self.words.passing.clear()
        parts = [list(map(look, words)) for words in split]
        if self.words.unknown:
            self._learn(set(self.words.unknown))
            self.words.unknown.clear()
            parts = [list(map(look, words)) if None in own else own for words, own in zip(split, parts, strict=True)]
        return [np.frombuffer(b"".join(own), "<u4") for own in parts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 for every id that occurs."""
    counts = np.bincount(ids)
    total = 1 << SCALE
    scaled = np.where(counts > 0, np.maximum(1, counts * total // len(ids)), 0)
    spare = total - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    if spare > 0:
        scaled[order[0]] += spare
    while spare < 0:  # too many rare ids were raised to 1: take from the frequent ones
        above = order[scaled[order] > 1]
        cut = np.minimum(scaled[above] - 1, np.maximum(1, scaled[above] * -spare // total))
        cut = np.where(np.cumsum(cut) <= -spare, cut, np.maximum(0, -spare - (np.cumsum(cut) - cut)))
        scaled[above] -= cut
        spare += int(cut.sum())
    return scaled.astype("<u4")


def code_block(ids: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> tuple[bytes, int]:
    """The block's bytes and its number of words."""
    lanes = min(LANES, len(ids))
    state = np.full(lanes, LOW, np.uint64)
    bound = np.uint64(63 - SCALE)
    words: list[np.ndarray] = []
    for begin in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        row = ids[begin : begin + lanes]
        x, f = state[: len(row)], freqs[row]
        full = x >= (f << bound)
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[: len(row)] = (q << np.uint64(SCALE)) + (x - q * f) + starts[row]
    stream = np.concatenate(words[::-1])
    return state.astype("<u8").tobytes() + stream.tobytes(), len(stream)


def decode_block(data: bytes, count: int, freqs: np.ndarray, starts: np.ndarray, id_of_slot: np.ndarray) -> np.ndarray:
    lanes = min(LANES, count)
    state = np.frombuffer(data, "<u8", lanes).copy()
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
    ids, at = np.empty(count, "<u4"), 0
    mask = np.uint64((1 << SCALE) - 1)
    for begin in range(0, count, lanes):
        x = state[: min(lanes, count - begin)]
        slot = x & mask
        row = id_of_slot[slot]
        ids[begin : begin + len(x)] = row
        x = freqs[row] * (x >> np.uint64(SCALE)) + slot - starts[row]
        short = np.flatnonzero(x < LOW)
        x[short] = (x[short] << WORD) | words[at : at + len(short)]
        at += len(short)
        state[: len(x)] = x
    return ids


def _tables(freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum(freqs, dtype=np.uint64) - freqs
    return freqs.astype(np.uint64), starts, np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)


BLOCK_TYPE = pa.struct([("offset", pa.int64()), ("n_tokens", pa.int32()), ("n_words", pa.int32()), ("crc", pa.int64())])


def _segment(part: int, seq: int, doc_ids: list, lists: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    ids = np.concatenate(lists)
    freqs = frequencies(ids)
    f, starts, _ = _tables(freqs)
    payload, blocks, offset = [], [], 0
    for first in range(0, len(ids), BLOCK):
        own = ids[first : first + BLOCK]
        data, n_words = code_block(own, f, starts)
        blocks.append({"offset": offset, "n_tokens": len(own), "n_words": n_words, "crc": zlib.crc32(own.tobytes())})
        payload.append(data)
        offset += len(data)
    table = zlib.compress(freqs.tobytes(), 6)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(kind)),
            pa.array([[len(x) for x in lists]], pa.list_(pa.int32())), pa.array([table], pa.binary()), pa.array([zlib.crc32(table)], pa.int64()),
            pa.array([blocks], pa.list_(BLOCK_TYPE)), pa.array([b"".join(payload)], pa.binary()),
        ],
        ["part", "seq", "n_tokens", "doc_ids", "lengths", "table", "table_crc", "blocks", "payload"],
    )


def write_tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> str:
    """Encode the texts and write the segments; returns the folder. ``path``: the tokenizer file on the executors."""
    from pyspark import TaskContext

    folder = shared_folder(docs.sparkSession, "tokens")
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        doc_ids, lists, kind = [], [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for first, texts in chunks(batch):
                for row, found in enumerate(encoder(path).encode(texts), first):
                    ids = np.append(found, np.uint32(end_id))
                    doc_ids.append(batch.column(0)[row].as_py())
                    lists.append(ids)
                    size += len(ids)
                    if size >= SEGMENT:
                        yield _segment(part, seq, doc_ids, lists, kind)
                        seq, size, doc_ids, lists = seq + 1, 0, [], []
        if lists:
            yield _segment(part, seq, doc_ids, lists, kind)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments = ordered.mapInArrow(
        run,
        f"part int, seq int, n_tokens bigint, doc_ids array<{id_kind}>, lengths array<int>, table binary, table_crc bigint, "
        "blocks array<struct<offset: bigint, n_tokens: int, n_words: int, crc: bigint>>, payload binary",
    )
    segments.write.option("compression", "none").parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian 32-bit numbers) of every document."""
    segments = spark.read.parquet(folder)
    id_kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, doc_ids, lengths, table, table_crc, blocks, payload = (batch.column(i)[row] for i in range(8))
                if zlib.crc32(table.as_buffer()) != table_crc.as_py():
                    raise ValueError("a frequency table is damaged")
                f, starts, id_of_slot = _tables(np.frombuffer(zlib.decompress(table.as_buffer()), "<u4"))
                data, found = memoryview(payload.as_buffer()), []
                for b in blocks.as_py():
                    end = b["offset"] + 8 * min(LANES, b["n_tokens"]) + 4 * b["n_words"]
                    ids = decode_block(data[b["offset"] : end], b["n_tokens"], f, starts, id_of_slot)
                    if zlib.crc32(ids.tobytes()) != b["crc"]:
                        raise ValueError("a block of ids is damaged")
                    found.append(ids)
                ends = np.cumsum(lengths.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                offsets = np.concatenate(([0], 4 * ends))
                n = len(ends)
                binary = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.concatenate(found))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), doc_ids.values,
                        pa.array(offsets[:-1] // 4), binary.cast(pa.binary()),
                    ],
                    ["part", "seq", "doc_id", "first", "ids"],
                )

    place = (F.col("part").cast("bigint") * F.lit(1 << 31) + F.col("seq")).alias("_place")
    sums = running_sum(segments.select("part", "seq", "n_tokens", place), [], "_place", "n_tokens", "_upto")
    before = measured(sums.select("part", "seq", (F.col("_upto") - F.col("n_tokens")).alias("_before")), 16)
    columns = segments.select("part", "seq", "doc_ids", "lengths", "table", "table_crc", "blocks", "payload")
    decoded = columns.mapInArrow(run, f"part int, seq int, doc_id {id_kind}, first bigint, ids binary")
    return decoded.join(before, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("_before")).alias("start"), "ids")
