"""Token operators against the libraries and by round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lorebase.llm import piece_codec, token_count, token_store  # noqa: E402


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_counts_match_the_library(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 512))
    got = token_count.count_tokens(odd, path, public_tokenizers.PATTERN)
    assert _rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_overlapping_pairs_merge_from_the_left():
    merger = token_count.Merger(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a" * n for n in range(1, 40)] + ["ab" * n + "a" for n in range(20)] + ["x", "", "the"]
    words = [w for w in words if w]
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert merger.symbols([w.encode() for w in words]).tolist() == want


def test_codec_matches_the_library_and_decodes(odd):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = piece_codec.encode(odd, path, public_tokenizers.PATTERN)
    assert encoded.columns == [*odd.columns, "token_ids"]
    both = piece_codec.encode_and_decode(odd, path, public_tokenizers.PATTERN)
    assert both.columns == [*odd.columns, "token_ids", "decoded"]
    for r in piece_codec.decode(encoded, path).collect() + both.collect():
        text = r["text"] or ""
        assert r["token_ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_model_is_serialised_from_the_ranks():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=piece_codec.model_bytes([bytes([b]) for b in range(256)] + [b"ab", b"abc"]))
    assert model.get_piece_size() == 259 and model.unk_id() == 258
    assert model.encode("abcab") == [257, 256] and model.get_score(257) == -257.0


def test_store_round_trip(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = token_store.read_tokens(spark, token_store.write_tokens(odd, path)).collect()
    want = {}
    for r in odd.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(r["doc_id"], []).append(ids.tobytes())
    order = sorted(found, key=lambda r: r["start"])
    at = 0
    for r in order:
        assert r["start"] == at
        at += len(r["ids"]) // 4
        assert bytes(r["ids"]) in want[r["doc_id"]]
    known = [r["doc_id"] for r in order]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0)) and len(found) == odd.count()
    assert token_store.read_tokens(spark, token_store.write_tokens(nothing, path)).collect() == []


def test_blocks_and_segments(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for size in (1, 5, 1023, 1024, 1025, 40_000):
        ids = np.minimum(rng.geometric(0.01, size), 49_000).astype("<u4")
        freqs = token_store.frequencies(ids)
        assert freqs.sum() == 1 << token_store.SCALE and (freqs[np.unique(ids)] > 0).all()
        f, starts, slots = token_store._tables(freqs)
        data, words = token_store.code_block(ids, f, starts)
        assert len(data) == 8 * min(size, token_store.LANES) + 4 * words
        assert np.array_equal(token_store.decode_block(data, size, f, starts, slots), ids)


def test_rare_ids_fit_the_table():
    ids = np.concatenate([np.arange(49_000), np.zeros(5_000_000, int)]).astype("<u4")
    freqs = token_store.frequencies(ids)
    assert freqs.sum() == 1 << token_store.SCALE and freqs.min() == 1


def test_damage_is_noticed(spark, odd):
    from pyspark.sql import functions as F

    from lorebase.llm.common import shared_folder

    folder = token_store.write_tokens(odd, public_tokenizers.path("word_bpe_49k.json"))
    broken = shared_folder(spark, "broken")
    cut = F.concat(F.expr("substring(payload, 1, octet_length(payload) - 2)"), F.lit(bytearray(b"\x00\x01")))
    spark.read.parquet(folder).withColumn("payload", cut).write.parquet(broken)
    with pytest.raises(Exception, match="damaged"):
        token_store.read_tokens(spark, broken).collect()


def test_checksums_are_of_the_bytes(spark):
    row = spark.sql("SELECT crc32(X'01000000') AS c, sha2('1 2', 256) AS s").first()
    assert row["c"] == zlib.crc32(np.array([1], "<u4").tobytes()) and row["s"] == hashlib.sha256(b"1 2").hexdigest()


def test_long_tokens_match_the_library_in_time():
    import random
    import time

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    merger, library, rng = token_count.Merger(path), Tokenizer.from_file(path), random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[:k], k=n)) for k in (1, 2, 4, 26) for n in (1, 2, 3, 50, 1023, 1025, 3000)]
    words += ["é" * 900, "日本" * 700, "ab" * 2000 + "a"]
    for word in words:
        want = len(library.encode(word, add_special_tokens=False).ids)
        assert merger.long_symbols(word.encode()) == merger.symbols([word.encode(), b"x"])[0] == want
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=1_000_000))
    began = time.process_time()
    found = merger.long_symbols(long.encode())
    assert time.process_time() - began < 10  # about 1.4 s on an idle core; rounds over the whole sequence take minutes
    assert found == len(library.encode(long, add_special_tokens=False).ids)


def test_counts_of_nothing(nothing):
    assert token_count.count_tokens(nothing, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).isEmpty()
