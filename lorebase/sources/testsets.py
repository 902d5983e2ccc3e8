"""Golden question sets as JSON lines: load, validate, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions.text import is_blank, strip
from lorebase.operators.ordering import positions

CASE_SCHEMA = "question string, expected_answer string, relevant_documents array<string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of one text file, numbered from 1 without a single-task sort."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    return positions(lines, [], "_at", "_pos").select((F.col("_pos") + 1).alias("line_no"), "line")


def checked_lines(lines: DataFrame) -> DataFrame:
    """(line_no, question, expected_answer, relevant_documents, issue) of the non-blank lines.

    ``issue`` is null, 'invalid JSON', 'validation error' or, for the second and later
    occurrence of a question among the valid lines, 'duplicate question'.
    """
    body = strip(F.col("line"))
    kept = lines.filter(~is_blank(F.col("line"))).select("line_no", body.alias("line"))
    parsed = kept.withColumn("_v", F.try_parse_json("line")).withColumn("_c", F.from_json("line", CASE_SCHEMA))

    def kind(path: str):
        return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))

    valid = (
        (kind("$.question") == "STRING") & (F.length("_c.question") >= 1)
        & (kind("$.expected_answer") == "STRING") & (F.length("_c.expected_answer") >= 1)
        & kind("$.relevant_documents").isin("ARRAY<STRING>") & (F.size("_c.relevant_documents") >= 1)
    )
    marked = parsed.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    first = (
        marked.filter("_valid").groupBy(F.col("_c.question").alias("question")).agg(F.min("line_no").alias("_first"))
    )
    joined = marked.withColumn("question", F.when(F.col("_valid"), F.col("_c.question"))).join(first, "question", "left")
    issue = (
        F.when(F.col("_v").isNull(), "invalid JSON")
        .when(~F.col("_valid"), "validation error")
        .when(F.col("line_no") > F.col("_first"), "duplicate question")
    )
    return joined.select(
        "line_no", F.col("_c.question").alias("question"), F.col("_c.expected_answer").alias("expected_answer"),
        F.col("_c.relevant_documents").alias("relevant_documents"), issue.alias("issue"),
    )


def issue_lines(checked: DataFrame) -> DataFrame:
    """(line_no, message) of everything a reviewer has to look at."""
    detail = F.when(F.col("issue") == "duplicate question", F.concat(F.lit(" - "), F.substring("question", 1, 60))).otherwise("")
    message = F.concat(F.lit("Line "), F.col("line_no"), F.lit(": "), F.col("issue"), detail)
    return checked.filter(F.col("issue").isNotNull()).select("line_no", message.alias("message"))


def load_test_set(spark: SparkSession, path: str) -> DataFrame:
    """Valid cases of a file; any bad line fails the file, repeated questions do not."""
    checked = checked_lines(numbered_lines(spark, path))
    counts = checked.agg(
        F.count("*").alias("n"), F.count_if(F.col("issue").isin("invalid JSON", "validation error")).alias("bad")
    ).first()
    if counts["bad"]:
        raise ValueError(f"test set validation errors: {counts['bad']} lines")
    if counts["n"] == 0:
        raise ValueError(f"test set is empty: {path}")
    return checked.select("line_no", "question", "expected_answer", "relevant_documents")


def write_test_set(cases: DataFrame, path: str) -> None:
    cases.select("question", "expected_answer", "relevant_documents").write.mode("overwrite").json(path)


def synthetic_cases(samples: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Generated samples -> cases: no empty question or answer, and a traceable source.

    ``samples``: sample_id, user_input, reference, response, reference_contexts;
    ``retrieved``: rank, source of the documents the generator was given. Contexts that
    are addresses win; otherwise the first retrieved source stands in.
    """
    fallback = retrieved.filter(F.coalesce("source", F.lit("")) != "").agg(F.min_by("source", "rank").alias("_source"))
    urls = F.filter(F.coalesce("reference_contexts", F.array().cast("array<string>")), lambda c: c.startswith("http"))
    answer = F.coalesce(F.nullif("reference", F.lit("")), F.col("response"), F.lit(""))
    filled = samples.filter(F.coalesce("user_input", F.lit("")) != "").withColumn("expected_answer", answer).filter("expected_answer <> ''")
    source = F.lit(fallback.first()["_source"]).cast("string")
    documents = F.when(F.size(urls) > 0, urls).when(source.isNotNull(), F.array(source))
    return (
        filled.withColumn("relevant_documents", documents).filter(F.col("relevant_documents").isNotNull())
        .select(F.col("user_input").alias("question"), "expected_answer", "relevant_documents")
    )


def generator_rows(count: int) -> int:
    """How many rows the generator retrieves for ``count`` cases."""
    return min(500, 10 * count)


def duplicates(cases: DataFrame, order: str) -> DataFrame:
    """Second and later occurrences of a question: later than its first, found with map-side combining."""
    first = cases.groupBy("question").agg(F.min(order).alias("_first"))
    return cases.join(first, "question").filter(F.col(order) > F.col("_first")).drop("_first").select(*cases.columns)
