"""Importance resampling towards a target distribution, with features counted once for each distinct line.

Separator newlines cut texts into lines. Words never reach over a newline, so the runs of
words inside a line depend on the line alone: they are taken once for every *distinct* line
and multiplied by the line's occurrences. Runs that reach over a newline, which exist from
two words on, are taken from the documents and added separately.

A feature is a run of 1 to ``n`` consecutive words, joined by one space; its bucket is the
crc32 of its UTF-8 bytes modulo ``buckets``. All documents hold S features (s in a bucket), all
target texts T (t in a bucket). A bucket's gain is floor(1000 ln((t+1)(S+b) / ((s+1)(T+b)))),
a document's weight the sum of its features' gains, and its score adds seeded Gumbel noise.
Of the documents with ``least_words`` words or more, the given percentage of highest scores is drawn.

Nothing but the gains, one number for each bucket, passes through the driver. Lines frequent
enough to fill a task (at most 4 for each shuffle partition, whatever the data) are broadcast
and their rows spread over all tasks; the draw's positions come from a range shuffle.

Nulls: a null text has no words, and its document is returned with weight 0. Rows without
doc_id come after all others among equal scores; their noise is that of an empty number.
Rows that agree in doc_id and text are scored alike and ranked one after the other. Other
columns are not read. Empty tables: no documents give no rows, no target gives T = 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import partitions, text_of, written
from lorebase.operators.ordering import sorted_positions

WORDS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024

#: A-Z to lower case; everything but digits, letters and bytes outside ASCII to a space.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def runs(words: list[bytes], n: int) -> list[bytes]:
    """All runs of 1 to ``n`` words."""
    longer = [b" ".join(words[i : i + k]) for k in range(2, n + 1) for i in range(len(words) - k + 1)]
    return words + longer


def crossing_runs(lines: list[list[bytes]], n: int) -> list[bytes]:
    """The runs of 2 to ``n`` words of a text that reach over a newline."""
    words = [w for line in lines for w in line]
    owner = [i for i, line in enumerate(lines) for _ in line]
    return [
        b" ".join(words[i : i + k]) for k in range(2, n + 1) for i in range(len(words) - k + 1) if owner[i] != owner[i + k - 1]
    ]


def _places(features: list[bytes], buckets: int) -> np.ndarray:
    crc = zlib.crc32
    return np.fromiter((crc(x) % buckets for x in features), np.uint32, len(features))


def _line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def line_features(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """h1, h2, occurrences, n_words, places (uint32 bucket numbers) of every distinct line of the texts."""
    lines = texts.select(F.explode(F.split(text_of(), "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("occurrences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = [], []
            for line in batch.column(3):
                words = words_of(line.as_py())
                counts.append(len(words))
                places.append(_places(runs(words, n), buckets).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(places, pa.binary())],
                ["h1", "h2", "occurrences", "n_words", "places"],
            )

    return lines.select(*_line_key(F.col("line")), "occurrences", "line").mapInArrow(
        run, "h1 bigint, h2 bigint, occurrences bigint, n_words bigint, places binary"
    )


def crossing_features(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """_doc, occurrences (1), places of the runs over newlines of every document, for ``n`` of 2 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [_places(crossing_runs([words_of(x) for x in (t.as_py() or "").split("\n")], n), buckets).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([1] * len(places), pa.int64()), pa.array(places, pa.binary())], ["_doc", "occurrences", "places"]
            )

    return docs.select(_document().alias("_doc"), "text").mapInArrow(run, "_doc bigint, occurrences bigint, places binary")


def bucket_counts(features: list[DataFrame], buckets: int) -> np.ndarray:
    """Features in every bucket: summed within tasks, then by bucket; ``buckets`` numbers at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for times, places in zip(batch.column(0), batch.column(1), strict=True):
                found, n = np.unique(np.frombuffer(places.as_py(), np.uint32), return_counts=True)
                total[found] += n * times.as_py()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = [x.select("occurrences", "places").mapInArrow(run, "bucket bigint, n bigint") for x in features]
    out = np.zeros(buckets, np.int64)
    for row in reduce(DataFrame.union, parts).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + b) / ((source + 1.0) * (t + b)))).astype(np.int64)


def _weighed(features: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_features and weight of every row's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [np.frombuffer(p.as_py(), np.uint32) for p in batch.column(len(keep))]
            sizes = np.array([len(p) for p in every], np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[np.concatenate(every)] if len(every) else gain[:0])))
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], [*keep, "n_features", "weight"]
            )

    kinds = ", ".join(f"{c} bigint" for c in keep)
    return features.select(*keep, "places").mapInArrow(run, f"{kinds}, n_features bigint, weight bigint")


def _document() -> Column:
    return F.xxhash64("doc_id", "text")


def weigh(docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs`` (doc_id, text); ``target`` has a column text."""
    lines = written(line_features(docs, n, buckets), "lines")
    crossing = [written(crossing_features(docs, n, buckets), "crossing")] if n > 1 else []
    wanted = [line_features(target, n, buckets)] + ([crossing_features(target.withColumn("doc_id", F.lit(None)), n, buckets)] if n > 1 else [])
    gain = gains(bucket_counts([lines, *crossing], buckets), bucket_counts(wanted, buckets))
    known = written(_weighed(lines, gain, ["h1", "h2", "occurrences", "n_words"]), "line-weights")
    total = known.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    # At most 4 P lines have over 1/(4 P) of all occurrences.
    values = ["n_words", "n_features", "weight"]
    hot = known.filter(F.col("occurrences") > total / (4 * partitions(docs.sparkSession)))
    hot = F.broadcast(hot.select("h1", "h2", F.struct(*values).alias("_hot")))
    rows = docs.select("doc_id", _document().alias("_doc"), F.posexplode(F.split(text_of(), "\n")).alias("_at", "_line"))
    rows = rows.select("doc_id", "_doc", "_at", *_line_key(F.col("_line"))).join(hot, ["h1", "h2"], "left")
    # Rows of hot lines have their numbers already; any other key spreads them.
    spread = lambda c: F.when(F.col("_hot").isNull(), F.col(c)).otherwise(F.xxhash64(F.lit(c), "_doc", "_at")).alias(c)
    rows = rows.select("doc_id", "_doc", "_at", spread("h1"), spread("h2"), "_hot")
    joined = rows.join(known.select("h1", "h2", F.struct(*values).alias("_cold")), ["h1", "h2"], "left")
    of = lambda c: F.sum(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}"))).alias(c)
    copies = F.count_if(F.col("_at") == 0)
    each = joined.groupBy("doc_id", "_doc").agg(copies.alias("_copies"), *[of(c) for c in values])
    if crossing:
        over = _weighed(crossing[0], gain, ["_doc"]).groupBy("_doc").agg(F.sum("n_features").alias("_n"), F.sum("weight").alias("_w"))
        each = each.join(over, "_doc").withColumn("n_features", F.col("n_features") + F.col("_n")).withColumn("weight", F.col("weight") + F.col("_w"))
    # Repeated rows have the same lines, so the sums are whole multiples.
    each = each.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return each.select("doc_id", *[F.expr(f"{c} div _copies").alias(c) for c in values])


def noise(seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256("seed:doc_id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (from 1; null where not drawn) of every row."""
    scored = written(weigh(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(seed)), "scores")
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
    placed = sorted_positions(eligible.select("*", order.alias("_order"), F.lit(0).alias("_all")), "_all", "_order", "_at")
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("bigint").alias("rank")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return placed.select(*columns, rank).union(rest)
