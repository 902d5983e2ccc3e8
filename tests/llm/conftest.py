from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"w{i}" for i in range(30_000))

#: Nulls, empty and blank texts, ties, repeated rows and a very long text; columns that clash with results.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "a", 1),
    (2, "the quick  brown fox jumps over the lazy dog near\tthe old river bank today", "a", 1),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank today", "b", 2),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank today", "b", 2),
    (4, None, "a", None),
    (5, "", None, 3),
    (6, " \t\n ", "b", 3),
    (None, "a text without a number", "a", 4),
    (None, None, None, None),
    (7, "Ünïcode 日本語 's I'LL <|endoftext|> ½ ２ x\x1cy\x85z q é ​", "c", 5),
    (8, LONG, "c", 6),
    (9, "one two\nthree four five six seven eight\n\nthree four five six seven eight", "a", 7),
    (10, "three four five six seven eight\nonly here and nowhere else at all", "b", 8),
    (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "b", 9),
]
SCHEMA = "doc_id bigint, text string, source string, kept int"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
