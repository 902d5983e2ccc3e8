"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (single tokens and pairs of neighbours) are counted:
one over the trusted documents, one over the whole corpus. A text's score is the sum of
log(p_trusted / p_corpus) over its n-grams, divided by their number, and every document
is held to the same threshold. Tokens are runs of letters and digits, and runs of other
characters, so that stray marks show.

Everything runs inside the row: no n-gram leaves its task except as one of ``BUCKETS``
counts, so no key can be hot and nothing but those counts is shuffled.

Nulls: a null text has no words and fails the base rules. Documents without doc_id are
scored but never trusted. Without trusted documents all scores are 0. A null score
(no tokens) counts as 0. Repeated rows are judged alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import BLANKS, let, text_of

#: Hash buckets of the n-grams: the size of the model.
BUCKETS = 1 << 15
#: At most so many labelled documents make the trusted sample, those of smallest hash.
TRUSTED_ROWS = 50_000
#: Texts whose mean log ratio lies below this are rejected.
THRESHOLD = -0.25
#: Counts added to every bucket, in units of the corpus distribution.
SMOOTHING = 1.0
#: Log ratios are rounded to whole multiples of this, so that sums do not depend on their order.
STEP = 0.001

MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window seen at least twice in the text."""
    width = REPEAT_WINDOW
    windows = F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(p, a)["h"] == F.get(p, b)["h"], F.lit(False))
            return F.transform(F.filter(p, lambda _, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"])

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda x, i: F.when(i == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(at, i - 1))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(F.sort_array(let(pairs, repeated)), length)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def base_counts() -> list[Column]:
    """The counts of the base rules over the column ``text``; ``_w`` holds two of them."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return [
        let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ]


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Bucket numbers of a text's tokens and of its pairs of neighbouring tokens."""
    spaced = F.regexp_replace(text, r"([^\p{L}\p{N}\x20\x09-\x0D]+)", " $1 ")
    hashes = F.transform(words_of(spaced), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)))
        singles = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)))
        return F.concat(singles, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))

    return let(hashes, grams)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """A bounded, repeatable sample of the documents labelled good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def gram_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array of log ratios in units of STEP, one for each bucket. Counts cover all documents."""
    marked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(trusted.withColumn("_good", F.lit(1))), "doc_id", "left")
    counts = marked.select(F.explode(gram_buckets(F.col("text"), buckets)).alias("b"), F.coalesce("_good", F.lit(0)).alias("g")).groupBy("b").agg(
        F.count("*").alias("n"), F.sum("g").alias("good")
    )
    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("b")).join(counts, "b", "left").fillna(0, ["n", "good"])
    listed = every.agg(F.sort_array(F.collect_list(F.struct("b", "n", "good"))).alias("x"), F.sum("n").alias("n"), F.sum("good").alias("good"))
    corpus = lambda x: (x["n"] + F.lit(SMOOTHING)) / (F.col("n") + F.lit(SMOOTHING * buckets))
    # The corpus distribution is the prior of the trusted one: what trusted texts say nothing about weighs little.
    prior = F.lit(SMOOTHING * buckets)
    weight = lambda x: F.log(((x["good"] + prior * corpus(x)) / (F.col("good") + prior)) / corpus(x))
    return listed.select(F.transform("x", lambda x: F.round(weight(x) / F.lit(STEP)).cast("int")).alias("weights"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    trusted_rows: int = TRUSTED_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every document's counts, score and verdict; the columns ``keep`` come along in a struct ``row``."""
    found = gram_weights(docs, trusted_ids(labels, trusted_rows), buckets).first()[0]  # as many numbers as there are buckets
    weights = F.split(F.lit(",".join(map(str, found))), ",").cast("array<int>")  # folded to a constant
    rows = docs.select("doc_id", text_of().alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")][: len(keep)])
    total = lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, b: a + F.get(weights, b.cast("int")))
    mean = lambda g: F.when(F.size(g) > 0, total(g) * F.lit(STEP) / F.size(g))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.select(*["row"][: len(keep)], "doc_id", *base_counts(), let(gram_buckets(F.col("text"), buckets), mean).alias("score"))
        .select(
            *["row"][: len(keep)], "doc_id", "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words",
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
