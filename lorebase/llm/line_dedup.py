"""Line dedup with a tree of line templates.

The tree has a fixed depth: the first level is the number of tokens, the next ``DEPTH``
levels are the leading tokens, where tokens with digits count as a field. In a leaf, a
token that only one of the leaf's different lines has at its place is a variable field.
If at most a fifth of the tokens are fields, the line's template is the line with fields
masked; otherwise the line is its own template. Two lines of one template so agree in
four fifths of their tokens, in the same places. A template found in several documents
is recurring: its lines stay in the document of smallest id and are dropped elsewhere.

By that rule, which the query's SQL sets, only lines of at least ``MIN_TOKENS`` tokens are
judged and a field's values must not recur. :func:`drop_lines` with ``linked`` has neither
limit. Two lines of a leaf that agree in four fifths of their places are linked, whatever
other lines have there, and the lines that links connect have one template. A line of
under ``MIN_TOKENS`` tokens has no room for a field; its template is the line itself.

Links are found without a row for each pair (:func:`line_links`): lines gather around a few
hubs, and only what lies around different hubs, or around none, is compared further.

Line counts, leaves and templates are kept as hashes in one narrow table; the text of a
line is read again only in leaves with different lines.

Nulls: a null text stays null. Rows without doc_id come after all others. Rows that
agree in doc_id and text are one document and get the same result. Other columns pass
through unchanged, in :func:`drop_lines`. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import BLANKS, BROADCAST_BYTES, let, measured, step, text_of, written
from lorebase.llm.simhash import components

DEPTH = 3
MIN_TOKENS = 5
MIN_DOCS = 2
SHARE_FIXED = 0.8
FIELD = "<*>"
#: Lines compared with each other in one row.
CELL = 32
#: Lines of a leaf beyond which it is dealt by blocks of places.
LARGE = 4096
#: Lines that gather others around them, in a group and round.
HUBS, ROUNDS = 8, 4


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANKS), "")


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def _lines(docs: DataFrame, least: int = MIN_TOKENS) -> DataFrame:
    """_doc, doc_id, _at and masked tokens of every judged line; lines of under MIN_TOKENS tokens have no fields."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_doc"), F.posexplode(F.split(text_of(), "\n")).alias("_at", "_line"))
    tokens = rows.withColumn("_raw", _tokens(F.col("_line"))).filter(F.size("_raw") >= least)
    masked = F.when(F.size("_raw") < MIN_TOKENS, F.col("_raw")).otherwise(_masked(F.col("_raw")))
    return tokens.select("doc_id", "_doc", "_at", masked.alias("_tokens"))


def _leaf() -> Column:
    return F.xxhash64(F.size("_tokens"), *[F.get("_tokens", F.lit(i)) for i in range(DEPTH)])


def _apart(a: Column, b: Column) -> Column:
    """Places where two lines differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda differs: differs))


def _near(x: Column, y: Column) -> Column:
    return _apart(x["_h"], y["_h"]) <= F.col("_d")


def _forest(lines: Column) -> Column:
    """Links (a, b) that connect the lines of one array as all their near pairs do: one for each line at most."""

    def label(labels: Column, i: Column) -> Column:
        line = F.get(lines, i)
        near = F.transform(F.filter(F.arrays_zip(F.slice(lines, F.lit(1), i).alias("l"), labels.alias("n")), lambda e: _near(e["l"], line)), lambda e: e["n"])
        joined = lambda found: F.concat(F.transform(labels, lambda n: F.when(F.array_contains(found, n), F.array_min(found)).otherwise(n)), F.array(F.array_min(found)))
        return let(near, lambda found: F.when(F.size(found) == 0, F.concat(labels, F.array(i))).otherwise(joined(found)))

    labels = F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), F.array().cast("array<int>"), label)
    links = lambda every: F.transform(every, lambda n, i: F.struct(F.get(lines, n)["_whole"].alias("a"), F.get(lines, i)["_whole"].alias("b")))
    return F.filter(let(labels, links), lambda e: e["a"] != e["b"])


def _dealt(lines: DataFrame) -> DataFrame:
    """Lines of very large groups by blocks of places: two near lines agree in one of ``_d`` + 1 blocks."""
    places = F.sequence(F.lit(DEPTH), F.size("_h") - 1)
    blocks = F.transform(F.sequence(F.lit(0), F.col("_d")), lambda b: F.filter(places, lambda p: F.pmod(p, F.col("_d") + 1) == b))
    rows = lines.select("*", F.posexplode(blocks).alias("_block", "_places"))
    shared = F.transform("_places", lambda p: F.get("_h", p))
    return rows.select(F.xxhash64("_group", "_block", shared).alias("_group"), "_whole", "_h", "_d")


def _starred(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (_group, _whole, _h, _d, _n) with the hub that took them (_star, null for the rest), and the links (a, b) to hubs.

    In a round some HUBS lines of each group, picked by their hash, take the lines near them.
    """
    rest, stars = wide, []
    for turn in range(ROUNDS):
        picked = rest.filter(F.pmod(F.xxhash64("_whole", F.lit(turn)), F.col("_n")) < HUBS)
        hubs = picked.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_whole", "_h"))).alias("_hubs"))
        met = rest.join(measured(written(hubs, "line-hubs"), 4096), "_group", "left")
        near = F.transform(F.filter(F.coalesce("_hubs", F.array()), lambda hub: _near(hub, F.struct("_h"))), lambda hub: hub["_whole"])
        marked = written(met.withColumn("_near", near).drop("_hubs"), "line-stars")
        stars.append(marked.filter(F.size("_near") > 0))
        rest = marked.filter(F.size("_near") == 0).drop("_near")
        if rest.isEmpty():
            break
    taken = reduce(DataFrame.union, stars)
    links = taken.select(F.explode("_near").alias("a"), F.col("_whole").alias("b")).filter("a <> b")
    labelled = taken.withColumn("_star", F.get("_near", F.lit(0))).drop("_near").union(rest.withColumn("_star", F.lit(None).cast("bigint")))
    return labelled, links


def _across(labelled: DataFrame, cell: int) -> DataFrame:
    """a, b: links between lines of one group and different stars, and inside the rest.

    Slices of ``cell`` lines meet in pairs. A star's lines are connected already, so a pair of
    slices of stars gives one link at most, a slice of the rest one for each of its lines.
    """
    counts = measured(written(labelled.groupBy("_group", "_star").agg(F.count("*").alias("_m")), "line-sizes"), 32)
    same = (labelled["_group"] == counts["_group"]) & labelled["_star"].eqNullSafe(counts["_star"])
    sized = labelled.join(counts, same).select(labelled["_group"], labelled["_star"], "_whole", "_h", "_d", "_m")
    part = F.pmod(F.xxhash64("_whole", F.lit("slice")), F.ceil(F.col("_m") / cell)).cast("int")
    slices = sized.groupBy("_group", "_star", part.alias("_part")).agg(F.collect_list(F.struct("_whole", "_h")).alias("_l"), F.first("_d").alias("_d"))
    several = counts.groupBy("_group").agg(F.count("*").alias("k"), F.count_if(F.col("_star").isNull()).alias("r")).filter("k > 1 OR r > 0").select("_group")
    slices = written(slices.join(measured(several, 8), "_group", "left_semi"), "line-slices")
    inside = slices.filter("_star IS NULL").select(F.explode(_forest(F.col("_l"))).alias("e")).select("e.*")
    one = slices.select("_group", F.col("_star").alias("_s"), "_part", "_l", "_d")
    two = slices.select("_group", F.col("_star").alias("_t"), F.col("_part").alias("_q"), F.col("_l").alias("_k"))
    # The rest comes first, so that it is on the left of every pair that has any.
    pairs = one.join(two, "_group").filter("(_s IS NULL AND (_t IS NOT NULL OR _part < _q)) OR (_s < _t)")
    hit = F.filter(F.transform("_l", lambda x: F.struct(x["_whole"].alias("b"), F.get(F.filter("_k", lambda y: _near(x, y)), F.lit(0))["_whole"].alias("a"))), lambda e: e["a"].isNotNull())
    found = F.when(F.col("_t").isNull(), F.transform(_forest(F.concat("_l", "_k")), lambda e: F.struct(e["b"].alias("b"), e["a"].alias("a"))))
    found = found.otherwise(F.when(F.col("_s").isNull(), hit).otherwise(F.slice(hit, 1, 1)))
    return inside.union(pairs.select(F.explode(found).alias("e")).select("e.a", "e.b"))


def line_links(distinct: DataFrame, cell: int = CELL, large: int = LARGE) -> DataFrame:
    """a, b: links between the lines (_leaf, _whole, _tokens) whose components are those of all linked pairs of a leaf.

    Lines link if at most ``_d`` places differ. A group of ``cell`` lines is compared in one
    row. In a larger one lines gather around hubs first, then slices of different stars and
    of the rest are compared; lines of one star never are. A group of over ``large`` lines is
    dealt once, by the blocks of places that two near lines must share.
    """
    groups = distinct.filter(F.size("_tokens") >= MIN_TOKENS).select(
        F.col("_leaf").alias("_group"), "_whole", F.transform("_tokens", lambda t: F.xxhash64(t)).alias("_h"),
        F.floor(F.size("_tokens") * F.lit(1 - SHARE_FIXED) + F.lit(1e-9)).cast("int").alias("_d"),
    )

    def sized(lines: DataFrame) -> DataFrame:
        sizes = written(lines.groupBy("_group").agg(F.count("*").alias("_n")).filter("_n > 1"), "line-sizes")
        return lines.join(measured(sizes, 16), "_group")

    groups = written(sized(groups), "line-groups")
    again = written(sized(_dealt(groups.filter(F.col("_n") > large))), "line-groups")
    groups = groups.filter(F.col("_n") <= large).unionByName(again)
    rows = groups.filter(F.col("_n") <= cell).groupBy("_group").agg(F.collect_list(F.struct("_whole", "_h")).alias("_l"), F.first("_d").alias("_d"))
    found = rows.select(F.explode(_forest(F.col("_l"))).alias("e")).select("e.*")
    wide = groups.filter(F.col("_n") > cell)
    if wide.isEmpty():
        return found
    labelled, links = _starred(wide)
    return found.union(links).union(_across(labelled, cell))


def linked_templates(docs: DataFrame) -> DataFrame:
    """doc_id, _doc, _at, template (a hash) of every line that has a token."""
    narrow, distinct = _mixed_leaves(_lines(docs, 1))
    found = measured(written(components(line_links(distinct)), "line-templates"), 16)
    return narrow.join(found, narrow["_whole"] == found["node"], "left").select("doc_id", "_doc", "_at", F.coalesce("root", "_whole").alias("template"))


def _mixed_leaves(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines without tokens, and one row for each different line of the leaves that have several."""
    whole = F.xxhash64("_tokens")
    narrow = written(lines.select("doc_id", "_doc", "_at", _leaf().alias("_leaf"), whole.alias("_whole")), "line-leaves")
    mixed = narrow.groupBy("_leaf").agg(F.min("_whole").alias("a"), F.max("_whole").alias("b")).filter("a <> b").select("_leaf")
    mixed = measured(written(mixed, "line-mixed"), 16)
    inside = lines.select(_leaf().alias("_leaf"), whole.alias("_whole"), "_tokens").join(mixed, "_leaf", "left_semi")
    # One row for each different line of those leaves; the tokens of equal hashes are equal.
    return narrow, written(inside.groupBy("_leaf", "_whole").agg(F.first("_tokens").alias("_tokens")), "line-texts")


def line_templates(docs: DataFrame) -> DataFrame:
    """doc_id, _doc, _at, template (a hash) of every judged line."""
    narrow, distinct = _mixed_leaves(_lines(docs))
    places = distinct.select("_leaf", "_whole", F.posexplode("_tokens").alias("_place", "_token"))
    lone = places.groupBy("_leaf", "_place", "_token").agg(F.count("*").alias("n"), F.min("_whole").alias("_whole")).filter("n = 1")
    # A template's hash: of all (place, token), with the tokens of its fields exchanged for the field mark.
    swap = F.bit_xor(F.xxhash64("_place", "_token").bitwiseXOR(F.xxhash64("_place", F.lit(FIELD))))
    fields = lone.groupBy("_leaf", "_whole").agg(F.count("*").alias("_fields"), swap.alias("_swap"))
    placed = F.transform("_tokens", lambda t, i: F.xxhash64(i, t))
    joined = F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
    general = distinct.select("_leaf", "_whole", F.size("_tokens").alias("_n"), joined.alias("_joined")).join(fields, ["_leaf", "_whole"])
    general = general.filter(F.col("_fields") <= F.col("_n") * F.lit(1 - SHARE_FIXED) + F.lit(1e-9))
    template = F.xxhash64("_leaf", F.col("_joined").bitwiseXOR(F.col("_swap")))
    general = measured(written(general.select("_leaf", "_whole", template.alias("_template")), "line-templates"), 32)
    return narrow.join(general, ["_leaf", "_whole"], "left").select(
        "doc_id", "_doc", "_at", F.coalesce("_template", "_whole").alias("template")
    )


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, linked: bool = False) -> DataFrame:
    """_doc, _drop: the places of the lines to drop in each document that has any."""
    lines = written(linked_templates(docs) if linked else line_templates(docs), "line-all")
    each = lines.groupBy("template", "_doc").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("doc_id"))
    found = each.groupBy("template").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_doc")).alias("_first")).filter(F.col("n") >= min_docs)
    found = measured(written(found.select("template", F.col("_first._doc").alias("_keeper")), "line-found"), 24)
    dropped = lines.join(found, "template").filter(F.col("_doc") != F.col("_keeper"))
    return dropped.groupBy("_doc").agg(F.collect_set("_at").alias("_drop"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, linked: bool = False) -> DataFrame:
    """The documents without their recurring lines, plus ``n_lines`` and ``n_dropped``.

    ``linked`` judges lines of any length, by links between lines.

    Columns of those names in the input are replaced.
    """
    with step():
        drops = written(recurring_lines(docs, min_docs, linked), "line-drops", outlasts=True)
    size = drops.agg(F.coalesce(F.sum(F.size("_drop") * 4 + 40), F.lit(0))).first()[0]
    drops = F.broadcast(drops) if size <= BROADCAST_BYTES else drops
    rows = docs.select(F.struct("*").alias("_row"), "text", F.xxhash64("doc_id", "text").alias("_doc")).join(drops, "_doc", "left")
    lines = F.split("text", "\n")
    places = lambda l: F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("_drop"))
    kept = let(lines, lambda l: F.array_join(F.transform(places(l), lambda i: F.get(l, i)), "\n"))
    columns = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return rows.select(
        *columns,
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("bigint").alias("n_dropped"),
    )
