"""Content trees (spaces, callouts, contributions) to documents.

A tree is three tables; ``frames_from_json`` makes them from nested JSON. Positions are
path strings that sort in pre-order: a space, then its callouts with their
contributions, then its subspaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase import fixed
from lorebase.functions.hashing import content_key
from lorebase.functions.text import heading, join_present, present, strip_html
from lorebase.operators.dedup import keep_first
from lorebase.session import checkpoint

#: Bytes of a text's SHA-256 that its row carries through the shuffle; digits would be 64, and nothing compresses them.
KEY_BYTES = 16
_PROFILE = "struct<displayName: string, description: string, url: string>"
_CALLOUT = (
    f"id: string, framing: struct<profile: {_PROFILE}>, contributions: array<struct<post: struct<id: string, profile: {_PROFILE}>, "
    f"whiteboard: struct<id: string, profile: {_PROFILE}, content: string>, link: struct<id: string, profile: {_PROFILE}, uri: string>>>"
)


def is_flat(bok_type: Column, flat_type: str = fixed.FLAT_TREE_TYPE) -> Column:
    """Knowledge bases are flat; every other type is a tree of spaces."""
    return F.coalesce(bok_type == flat_type, F.lit(False))


def _padded(pos: Column) -> Column:
    return F.lpad(pos.cast("string"), 20, "0")


def read_answers(answers: DataFrame, flat_type: str = fixed.FLAT_TREE_TYPE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collection, bok_type, body JSON) -> spaces, callouts, contributions.

    The type picks the flat or the tree reading; unknown types read as trees. The text is
    parsed once, to a variant; a tree is walked level by level over parts of it, until no
    space has subspaces. A body that is no JSON gives nothing.
    """
    flat = is_flat(F.col("bok_type"), flat_type)
    parsed = answers.withColumn("_v", F.try_parse_json("body"))
    top = lambda path: F.try_variant_get("_v", path, "variant")
    current = parsed.select(
        "collection", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("parent_id"), F.when(flat, "knowledge").alias("top_type"),
        F.when(flat, top("$.lookup.knowledgeBase")).otherwise(top("$.lookup.space")).alias("_s"),
    )
    levels = []
    while True:
        level = checkpoint(current.filter(F.try_variant_get("_s", "$", "map<string, variant>").isNotNull()))
        if level.isEmpty() and levels:
            break
        levels.append(_spaces_of(level))
        inner = F.when(F.col("top_type") == "knowledge", F.lit(None)).otherwise(F.try_variant_get("_s", "$.subspaces", "array<variant>"))
        current = level.select("collection", F.try_variant_get("_s", "$.id", "string").alias("parent_id"), "top_type", F.posexplode(inner).alias("pos", "_s"))
    spaces = reduce(DataFrame.unionByName, levels)
    callouts = spaces.select("collection", F.col("id").alias("space_id"), F.posexplode("callouts").alias("pos", "c"))
    contributions = callouts.select("collection", F.col("c.id").alias("callout_id"), F.posexplode("c.contributions").alias("pos", "x"))
    return (
        spaces.drop("callouts"),
        callouts.select("collection", "space_id", "pos", F.col("c.id").alias("id"),
                        F.col("c.framing.profile.displayName").alias("name"),
                        F.col("c.framing.profile.description").alias("description"),
                        F.col("c.framing.profile.url").alias("url")),
        reduce(DataFrame.unionByName, [
            _contributions_of(contributions, "post", F.col("x.post.profile.description"), F.lit(None).cast("string")),
            _contributions_of(contributions, "whiteboard", F.col("x.whiteboard.content"), F.lit(None).cast("string")),
            _contributions_of(contributions, "link", F.col("x.link.profile.description"), F.col("x.link.uri")),
        ]),
    )


def _spaces_of(level: DataFrame) -> DataFrame:
    text = lambda path: F.try_variant_get("_s", path, "string")
    callouts = [F.try_variant_get("_s", f"$.{path}", f"array<struct<{_CALLOUT}>>") for path in ("collaboration.calloutsSet.callouts", "calloutsSet.callouts")]
    return level.select(
        "collection", "parent_id", "pos", "top_type",
        text("$.id").alias("id"),
        text("$.profile.displayName").alias("name"),
        text("$.profile.description").alias("description"),
        text("$.profile.url").alias("url"),
        F.coalesce(*callouts).alias("callouts"),
    )


def _contributions_of(rows: DataFrame, kind: str, body: Column, uri: Column) -> DataFrame:
    return rows.filter(F.col(f"x.{kind}").isNotNull()).select(
        "collection", "callout_id", "pos",
        F.lit(kind).alias("kind"),
        F.col(f"x.{kind}.id").alias("id"),
        F.col(f"x.{kind}.profile.displayName").alias("name"),
        body.alias("body"),
        uri.alias("uri"),
        F.col(f"x.{kind}.profile.url").alias("url"),
    )


def space_paths(spaces: DataFrame) -> DataFrame:
    """Adds ``depth`` and the pre-order ``path`` of every space below a top, by pointer jumping.

    A node knows an ancestor and its path from there; in a round it takes over what that
    ancestor knows, so the distance doubles, and a tree of depth d takes about log2(d) rounds
    over narrow rows. A space that is its own ancestor is not entered again, so a cycle ends;
    spaces that reach no top get no path.
    """
    key = ["collection", "id", "parent_id", "pos"]
    step = F.when(F.col("parent_id").isNull(), _padded(F.col("pos"))).otherwise(F.concat(F.lit("/s"), _padded(F.col("pos"))))
    depth = F.col("parent_id").isNotNull().cast("int")
    nodes = spaces.select(*key).distinct().select(
        *key, F.col("parent_id").alias("_top"), step.alias("path"), depth.alias("depth"), F.array("id").alias("_line")
    )
    waiting = checkpoint(nodes)
    placed = [waiting.filter("_top IS NULL")]
    while True:
        waiting = waiting.filter("_top IS NOT NULL")
        known = reduce(DataFrame.unionByName, [*placed, waiting]).select(
            "collection", F.col("id").alias("_top"), F.col("_top").alias("_above"), F.col("path").alias("_p"), F.col("depth").alias("_d"), F.col("_line").alias("_l")
        )
        jumped = waiting.join(known, ["collection", "_top"]).filter(~F.arrays_overlap("_l", "_line"))
        waiting = checkpoint(jumped.select(
            *key, F.col("_above").alias("_top"), F.concat("_p", "path").alias("path"), (F.col("_d") + F.col("depth")).alias("depth"),
            F.concat("_l", "_line").alias("_line"),
        ))
        if waiting.isEmpty():
            break
        placed.append(waiting.filter("_top IS NULL"))
    found = reduce(DataFrame.unionByName, placed).select(*[F.col(c).alias(f"_{c}") for c in key], "path", "depth")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return spaces.join(found, same).select(*spaces.columns, "path", "depth")


def callout_context(name: Column, description: Column) -> Column:
    short = F.substring(strip_html(description), 1, fixed.CALLOUT_CONTEXT_CHARS)
    return join_present([name, F.when(present(description), short)])


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _space_documents(placed: DataFrame) -> DataFrame:
    kind = F.when(F.col("depth") > 0, "subspace").otherwise(F.coalesce("top_type", F.lit("space")))
    return placed.filter(present(F.col("description"))).select(
        "collection", "path", F.col("id").alias("document_id"), F.concat(F.lit("space:"), "id").alias("source"),
        kind.alias("type"), _text("name").alias("title"), F.col("url").alias("uri"),
        F.concat(_text("name"), F.lit("\n\n"), F.col("description")).alias("content"),
    )


def _callout_documents(placed: DataFrame) -> DataFrame:
    return placed.filter(present(F.col("description"))).select(
        "collection", "path", F.col("id").alias("document_id"), F.concat(F.lit("callout:"), "id").alias("source"),
        F.lit("callout").alias("type"), _text("name").alias("title"), F.col("url").alias("uri"),
        F.concat(_text("name"), F.lit("\n\n"), F.col("description")).alias("content"),
    )


def contribution_content(kind: Column, context: Column, title: Column, body: Column, uri: Column, fetched: Column) -> Column:
    """Enriched text of a post, a whiteboard or a link (with or without its fetched body)."""
    written = join_present([context, heading(title), body])
    with_body = join_present([heading(title), body, fetched])
    without_body = join_present([context, heading(title), body, F.when(present(uri), F.concat(F.lit("URL: "), uri))])
    return F.when(kind != "link", written).when(present(fetched), with_body).otherwise(without_body)


def _contribution_documents(placed: DataFrame) -> DataFrame:
    link = F.col("kind") == "link"
    filled = F.when(link, present(F.col("uri")) | present(F.col("name")) | present(F.col("body"))).otherwise(present(F.col("body")))
    return placed.filter(filled).select(
        "collection", "path", F.col("id").alias("document_id"),
        F.concat(F.col("kind"), F.lit(":"), F.col("id")).alias("source"), F.col("kind").alias("type"),
        _text("name").alias("title"),
        F.when(link & present(F.col("uri")), F.col("uri")).otherwise(F.col("url")).alias("uri"),
        contribution_content(F.col("kind"), F.col("context"), F.col("name"), F.col("body"), F.col("uri"), F.col("fetched_text")).alias("content"),
    )


def tree_documents(
    spaces: DataFrame,
    callouts: DataFrame,
    contributions: DataFrame,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """Documents of the trees in pre-order, without markup, blanks and repeats.

    ``fetched`` (uri, fetched_text) holds the extracted bodies of links. Of equal texts,
    compared without case and white space, the first in pre-order stays.
    """
    placed = space_paths(spaces)  # read three times; its levels are checkpoints
    space_at = placed.select("collection", F.col("id").alias("space_id"), F.col("path").alias("_above"))
    called = callouts.join(space_at, ["collection", "space_id"]).withColumn(
        "path", F.concat("_above", F.lit("/c"), _padded(F.col("pos")))
    )
    callout_at = called.select(
        "collection", F.col("id").alias("callout_id"), F.col("path").alias("_above"),
        callout_context(F.col("name"), F.col("description")).alias("context"),
    )
    kind_order = F.when(F.col("kind") == "post", "0").when(F.col("kind") == "whiteboard", "1").otherwise("2")
    contributed = contributions.join(callout_at, ["collection", "callout_id"]).withColumn(
        "path", F.concat("_above", F.lit("/p"), _padded(F.col("pos")), kind_order)
    )
    if fetched is None:
        contributed = contributed.withColumn("fetched_text", F.lit(None).cast("string"))
    else:
        # what has no address meets no body and stays where it is; as null keys, all of it would go to one task
        linked = contributed.filter(F.col("uri").isNotNull()).join(fetched.select("uri", "fetched_text"), "uri", "left")
        plain = contributed.filter(F.col("uri").isNull()).withColumn("fetched_text", F.lit(None).cast("string"))
        contributed = linked.unionByName(plain)
    raw = reduce(DataFrame.unionByName, [
        _space_documents(placed), _callout_documents(called), _contribution_documents(contributed)
    ])
    cleaned = raw.withColumn("content", strip_html(F.col("content")))
    plain_title = strip_html(F.col("title"))
    key = F.substring(F.unhex(content_key(F.col("content"))), 1, KEY_BYTES)
    # blanks share one key; dropping them after the choice keeps the clean-up from running twice
    return (
        keep_first(cleaned.withColumn("_key", key), ["collection", "_key"], "path")
        .filter(F.col("content") != "")
        .drop("_key")
        .withColumn("title", F.when(plain_title != "", plain_title).otherwise(F.col("title")))
        .withColumn("uri", F.nullif(F.col("uri"), F.lit("")))
    )


def link_counts(contributions: DataFrame, fetched: DataFrame) -> DataFrame:
    """Links whose body gave text and links that were skipped."""
    links = contributions.filter((F.col("kind") == "link") & present(F.col("uri")))
    joined = links.join(fetched.select("uri", "fetched_text"), "uri", "left")
    got = present(F.col("fetched_text"))
    return joined.groupBy("collection").agg(F.count_if(got).alias("fetched"), F.count_if(~got).alias("skipped"))
