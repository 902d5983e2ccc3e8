"""Byte-level BPE encoding and decoding with a sentencepiece model made from the ranks.

The vocabulary file's byte strings become the pieces of a sentencepiece BPE model: each
byte is mapped to a printable letter, a piece's score is its negative rank, and text is
not normalised. sentencepiece then merges the pair of best score, leftmost first, which
is the lowest rank. The model is written byte by byte as protocol buffer fields; nothing
is trained. Texts are cut into pre-tokens before encoding; ids become bytes again by the
inverse of the letter mapping.

Nulls: a null text is empty and has no ids. Rows without doc_id are encoded too.
Repeated rows give repeated results. Other columns pass through unchanged; columns named
``token_ids`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.pretokens import MEMORY, chunks, splitter
from lorebase.llm.token_count import byte_letters

# Field numbers and values of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND, NORMAL, UNKNOWN = 1, 2, 3, 1, 2
MODEL_TYPE, BPE, UNK_ID = 3, 2, 40
RULE_NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5
VARINT, BYTES, FLOAT = 0, 2, 5


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, kind: int, value: bytes | int | float) -> bytes:
    head = _number(number << 3 | kind)
    if kind == VARINT:
        return head + _number(value)
    if kind == FLOAT:
        return head + struct.pack("<f", value)
    return head + _number(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The byte string of every rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in ranked]


def model_bytes(tokens: Sequence[bytes]) -> bytes:
    """A sentencepiece model whose piece number is the rank; the unknown piece comes last."""
    letters = byte_letters()
    pieces = [
        _field(PIECE, BYTES, "".join([letters[b] for b in token]).encode()) + _field(SCORE, FLOAT, -float(rank)) + _field(KIND, VARINT, NORMAL)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(PIECE, BYTES, b"<unk>") + _field(SCORE, FLOAT, -float(len(tokens))) + _field(KIND, VARINT, UNKNOWN))
    trainer = _field(MODEL_TYPE, VARINT, BPE) + _field(UNK_ID, VARINT, len(tokens))
    normalizer = _field(RULE_NAME, BYTES, b"identity") + b"".join(_field(n, VARINT, 0) for n in (DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS))
    return b"".join(_field(PIECES, BYTES, p) for p in pieces) + _field(TRAINER, BYTES, trainer) + _field(NORMALIZER, BYTES, normalizer)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        letters = byte_letters()
        self.letter_of = dict(enumerate(letters))
        byte_of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [bytes([byte_of[c] for c in self.model.id_to_piece(i)]) for i in range(len(tokens))]
        self.memory: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str], pattern: str) -> list[np.ndarray]:
        """Ids of each text. The memory holds the ids of pre-tokens as little-endian 32-bit numbers."""
        find, known = splitter(pattern).findall, self.memory
        tokens = [find(text) for text in texts]
        fresh = list({t for own in tokens for t in own if t not in known})
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            fresh = list({t for own in tokens for t in own})
        mapped = [t.encode().decode("latin-1").translate(self.letter_of) for t in fresh]
        for token, ids in zip(fresh, self.model.encode(mapped, out_type=int, num_threads=1), strict=True):
            known[token] = struct.pack(f"<{len(ids)}i", *ids)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), "<i4") for own in tokens]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _with_column(docs: DataFrame, name: str, kind: str, source: str, make, keep: bool) -> DataFrame:
    """The rows with a column that ``make`` derives from batches of ``source``; it replaces one of that name."""
    others = [c for c in docs.columns if c != name and (keep or c != source)]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{source}`").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, made in make(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(made)), made], ["row", "made"])

    shape = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"row {shape}, made {kind}")
    return out.select(*[F.col(f"row.`{c}`") for c in others], F.col("made").alias(name))


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", keep: bool = True) -> DataFrame:
    """The documents with ``token_ids``, and without the text unless ``keep``. ``path`` names the ranks file on the executors."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
        for first, texts in chunks(batch):
            found = codec(path).encode(texts, pattern)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield first, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))

    return _with_column(docs, "token_ids", "array<int>", column, make, keep)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, column: str = "text", keep: bool = True) -> DataFrame:
    """The documents with ``token_ids`` and, made from these, ``decoded``, in one pass through the workers."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
        for first, texts in chunks(batch):
            found = codec(path).encode(texts, pattern)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            decoded = pa.array([codec(path).decode(x) for x in found], pa.binary())
            yield first, pa.StructArray.from_arrays([ids, decoded], ["token_ids", "decoded"])

    made = _with_column(docs, "_made", "struct<token_ids: array<int>, decoded: binary>", column, make, keep)
    others = [F.col(f"`{c}`") for c in made.columns if c not in ("_made", "token_ids", "decoded")]
    return made.select(*others, "_made.token_ids", "_made.decoded")


def decode(encoded: DataFrame, path: str, column: str = "token_ids", keep: bool = True) -> DataFrame:
    """The rows with ``decoded``, the bytes that the ids stand for (null ids give none), and without the ids unless ``keep``."""

    def make(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
        lists = batch.column(1)
        for first in range(0, batch.num_rows, 256):
            part = [lists[i] for i in range(first, min(first + 256, batch.num_rows))]
            yield first, pa.array([codec(path).decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in part], pa.binary())

    return _with_column(encoded, "decoded", "binary", column, make, keep)
