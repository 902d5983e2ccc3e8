"""Breadth-first reading of sites from a table of fetched pages.

The pages are parsed once, into a narrow table of addresses and link targets. All sites
advance over it together, one level per round: the frontier is an anti-join with what has
been visited, a join with the table is the fetch, and the targets of the fetched pages
are the next frontier. A site stops when it has its page limit. The markup is joined
once, at the end, for the pages reached.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.arrow import arrow_function
from lorebase import fixed
from lorebase.functions import urls
from lorebase.operators.dedup import keep_first
from lorebase.session import checkpoint, materialised


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)  # of a repeated attribute, the last one counts
        if tag == "a" and "href" in given:
            self.found.append(given["href"] or "")


def _hrefs(html: str) -> list[str]:
    parser = _Links()
    parser.feed(html)
    parser.close()
    return parser.found


@arrow_function(T.ArrayType(T.StringType()))
def hrefs(pages: pd.Series) -> pd.Series:
    return pages.map(_hrefs, na_action="ignore")


def targets_of(url: Column, found: Column) -> Column:
    """Normalised targets of a page's links, in order."""
    return F.transform(urls.resolve_all(url, found), urls.normalize)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, html, ...) -> one row per link: link position, href and normalised target."""
    kept = [c for c in pages.columns if c != "html"]
    exploded = pages.select(*kept, F.posexplode(hrefs("html")).alias("link_pos", "href"))
    return exploded.withColumn("target", urls.normalize(urls.resolve(F.col("url"), F.col("href"))))


def followable(base: Column, target: Column) -> Column:
    return urls.same_domain(base, target) & ~urls.skipped_file(target)


def is_html(content_type: Column) -> Column:
    return F.contains(F.coalesce(content_type, F.lit("")), F.lit("text/html"))


def crawl(pages: DataFrame, seeds: DataFrame, page_limit: int = fixed.PAGE_LIMIT) -> DataFrame:
    """(base_url, url, html, rank) of the pages reached from every seed.

    ``pages`` has (url, html) and optionally ``content_type``, ``final_url``, the
    address after redirects, and ``position``, a unique number that picks the first of
    several rows that normalise to one address; ``seeds`` has (base_url). Unsafe seeds give nothing.
    """
    if "content_type" not in pages.columns:
        pages = pages.withColumn("content_type", F.lit("text/html"))
    if "final_url" not in pages.columns:
        pages = pages.withColumn("final_url", F.col("url"))
    if "position" not in pages.columns:
        pages = pages.withColumn("position", F.xxhash64("url", "html"))
    addressed = pages.withColumn("final_url", urls.normalize(F.col("final_url"))).withColumn("url", urls.normalize(F.col("url")))
    links = addressed.withColumn("_hrefs", hrefs("html")).select(
        "url", "final_url", "content_type", "position", targets_of(F.col("url"), F.col("_hrefs")).alias("targets")
    )
    index = materialised(keep_first(links, ["url"], "position"))
    answering = index.filter(is_html(F.col("content_type")))
    frontier = (
        seeds.select("base_url").distinct().filter(urls.is_safe(F.col("base_url")))
        .select("base_url", urls.normalize(F.col("base_url")).alias("url"), F.lit(0).alias("parent_rank"), F.lit(0).alias("link_pos"))
        .filter(~urls.skipped_file(F.col("url")))
    )
    visited = frontier.select("base_url", "url").limit(0)
    reached = None
    while True:
        first = Window.partitionBy("base_url", "url").orderBy("parent_rank", "link_pos")
        fresh = (
            frontier.join(visited, ["base_url", "url"], "left_anti")
            .withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        )
        fresh = checkpoint(fresh)
        if fresh.isEmpty():
            break
        answered = fresh.join(answering, "url")
        order = Window.partitionBy("base_url").orderBy("parent_rank", "link_pos")
        leading = answered.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= page_limit)
        if reached is None:
            placed = leading.withColumn("rank", F.col("_n"))
        else:
            counts = reached.groupBy("base_url").agg(F.count("*").alias("_have"))
            placed = leading.join(counts, "base_url", "left").withColumn("rank", F.coalesce("_have", F.lit(0)) + F.col("_n"))
        level = checkpoint(placed.filter(F.col("rank") <= page_limit).select(
            "base_url", "url", "final_url", "position", F.col("rank").cast("int").alias("rank"), "targets"
        ))
        kept = level.drop("targets")
        reached = kept if reached is None else reached.unionByName(kept)
        found = level.select("base_url", F.col("rank").alias("parent_rank"), F.posexplode("targets").alias("link_pos", "url"))
        frontier = found.filter(followable(F.col("base_url"), F.col("url"))).select("base_url", "url", "parent_rank", "link_pos")
        visited = visited.unionByName(fresh.select("base_url", "url"))
    if reached is None:
        return pages.select(F.col("url").alias("base_url"), "url", "html", F.lit(0).alias("rank")).limit(0)
    markup = addressed.select("url", "position", "html")
    return reached.join(markup, ["url", "position"]).select("base_url", F.col("final_url").alias("url"), "html", "rank")


def unreachable(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds whose first request fails; other failed requests are only left out."""
    have = pages.select(urls.normalize(F.col("url")).alias("_url"))
    asked = seeds.withColumn("_url", urls.normalize(F.col("base_url")))
    return asked.join(have, "_url", "left_anti").select("base_url")
