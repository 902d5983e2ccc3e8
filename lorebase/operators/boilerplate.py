"""Paragraphs that recur on many pages of a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.text import folded, is_blank, ordered_lines
from lorebase.session import broadcast_limit, checkpoint


def paragraphs(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(site, page_id, content) -> one row per paragraph with its comparison key."""
    parts = F.split("content", separator.replace("\n", r"\n"), -1)
    return pages.select("site", "page_id", F.posexplode(parts).alias("pos", "paragraph")).withColumn(
        "key", folded(F.col("paragraph"))
    )


def boilerplate_keys(
    pages: DataFrame,
    threshold: float = fixed.BOILERPLATE_THRESHOLD,
    min_pages: int = fixed.BOILERPLATE_MIN_PAGES,
    separator: str = "\n\n",
) -> DataFrame:
    """(site, key, n_pages) of paragraphs on strictly more than the given share of pages.

    Distinct pages are counted as distinct (key, page) pairs first, so that a paragraph
    on every page is spread over the pages before it is counted with map-side combining.
    """
    sizes = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    counted = (
        paragraphs(pages, separator)
        .filter(F.length("key") >= fixed.MIN_BOILERPLATE_KEY)
        .select("site", "key", "page_id")
        .distinct()
        .groupBy("site", "key")
        .agg(F.count("*").alias("n_pages"))
    )
    enough = (F.col("site_pages") >= min_pages) & (F.col("n_pages") > threshold * F.col("site_pages"))
    return counted.join(sizes, "site").filter(enough).select("site", "key", "n_pages")


def without_boilerplate(
    pages: DataFrame,
    threshold: float = fixed.BOILERPLATE_THRESHOLD,
    min_pages: int = fixed.BOILERPLATE_MIN_PAGES,
    separator: str = "\n\n",
) -> DataFrame:
    """(site, page_id, content) without the recurring paragraphs; emptied pages are dropped.

    The keys are written and measured. While they are small, the list of a site's keys
    meets the page rows as a broadcast and the paragraphs are filtered inside the row, so
    that no text is shuffled. Beyond the session's broadcast limit, paragraphs become rows
    with a key of their page's row, and an anti-join drops the recurring ones. Both ways give
    a row for every row, also where rows share site and page_id or are repeated.
    """
    keys = checkpoint(boilerplate_keys(pages, threshold, min_pages, separator).select("site", "key"))
    size = keys.agg(F.coalesce(F.sum(F.octet_length("site") + F.octet_length("key") + 64), F.lit(0))).first()[0]
    if size <= broadcast_limit(pages.sparkSession):
        listed = F.broadcast(keys.groupBy("site").agg(F.collect_set("key").alias("_keys")))
        parts = F.split("content", separator.replace("\n", r"\n"), -1)
        own = F.filter(parts, lambda p: ~F.array_contains("_keys", folded(p)))
        marked = pages.select("site", "page_id", "content").join(listed, "site", "left")
        whole = F.when(F.col("_keys").isNull(), F.col("content")).otherwise(F.array_join(own, separator))
        # a generator: a filter is not pushed through it, which would compute the text twice
        once = marked.select("site", "page_id", F.explode(F.array(whole)).alias("content"))
        return once.filter(~is_blank(F.col("content")))
    row = F.xxhash64("site", "page_id", "content")
    parts = F.posexplode(F.split("content", separator.replace("\n", r"\n"), -1)).alias("pos", "paragraph")
    rows = pages.select("site", "page_id", row.alias("_row"), parts).withColumn("key", folded(F.col("paragraph")))
    kept = rows.join(keys, ["site", "key"], "left_anti").groupBy("site", "page_id", "_row", "pos").agg(
        F.first("paragraph").alias("paragraph"), F.count("*").alias("_copies")
    )
    cleaned = kept.groupBy("site", "page_id", "_row").agg(
        ordered_lines(F.col("pos"), F.col("paragraph"), separator).alias("content"), F.max("_copies").cast("int").alias("_copies")
    )
    each = cleaned.filter(~is_blank(F.col("content"))).select("site", "page_id", "content", F.explode(F.sequence(F.lit(1), "_copies")))
    return each.select("site", "page_id", "content")
