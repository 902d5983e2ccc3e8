"""Blocks of a page from pre and post numbers.

An element's pre number counts the starts up to its own, its post number the ends up to its own.
Of two elements the one with the smaller pre and the larger post number contains the other; a
piece of text lies in an element that has started before it and not ended yet. So nesting is a
comparison of numbers, and depth, removal and text of every element are array functions over
the page's own row, without a tree, a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions.html import outline


def contains(outer: Column, inner: Column) -> Column:
    """Whether an element contains another, or is it."""
    return (outer["pre"] <= inner["pre"]) & (outer["post"] >= inner["post"])


def holds(element: Column, piece: Column) -> Column:
    return (element["pre"] <= piece["starts"]) & (element["post"] > piece["ends"])


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' other columns with pre, post, depth, tag, removed and text of every element.

    The text joins the element's pieces but for those in removed elements. A page without
    elements, or null, gives no rows.
    """
    kept = [c for c in pages.columns if c != html]
    numbered = pages.select(*kept, F.explode(F.array(outline(F.col(html)))).alias("_o"))  # a generator, so that pages are read once
    dropped = F.filter("_o.elements", lambda e: e["own"])
    seen = numbered.select(*kept, F.col("_o.elements").alias("_e"), dropped.alias("_d"), F.col("_o.pieces").alias("_p")).withColumn(
        "_p", F.filter("_p", lambda p: ~F.exists("_d", lambda d: holds(d, p)))
    )
    block = F.transform("_e", lambda e: F.struct(
        e["pre"].alias("pre"), e["post"].alias("post"), F.size(F.filter("_e", lambda o: contains(o, e))).alias("depth"), e["tag"].alias("tag"),
        F.exists("_d", lambda d: contains(d, e)).alias("removed"),
        F.array_join(F.transform(F.filter("_p", lambda p: holds(e, p)), lambda p: p["text"]), "").alias("text"),
    ))
    return seen.select(*kept, F.explode(block).alias("_b")).select(*kept, "_b.*")
