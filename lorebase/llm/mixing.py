"""Mixing sources to target weights: budgets down a tree, prefixes of seeded epochs.

The token budget goes down a tree of columns (domain, language, source). Siblings share
their parent's budget by weight; what a child cannot use goes to its siblings, and only
when they are full does the parent take less, so that its own siblings get the rest. A
leaf can be read ``max_epochs`` times. Its budget is spent on whole epochs and a prefix
of one more: in each epoch its documents have a seeded order, and the prefix is what
fits into the rest of the budget.

The tree is a table with one row for each leaf, of any number; budgets are shared out level by
level with joins and windows over narrow rows, and nothing of it reaches the driver but the
corpus's token sum. The prefix's end is found without sorting a leaf: token sums of 4,096 hash
ranges give the range that holds it, and only that range's documents are put in order.

Nulls: a null level is the leaf level '' (empty). A null text has no tokens; such
documents cost nothing and belong to every epoch read in whole, and to the prefix if
their turn comes before its end. Rows that agree in doc_id and text have one place in
the order and come or stay together. Extra columns pass through unchanged. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import BLANKS, measured, text_of, written

BIN_DIGITS = 3


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    """The weight of a child by its name; 1 if the recipe does not name it."""
    known = F.lit(1)
    for child, weight in weights.items():
        known = F.when(F.col(name) == child, weight).otherwise(known)
    return known.cast("bigint")


def leaf_budgets(leaves: DataFrame, names: Sequence[str], budget: int, weights: Sequence[Mapping[str, int]]) -> DataFrame:
    """The columns ``names`` and ``budget`` of every leaf (names, cap: what it can use at most).

    In each level the children of a node are filled to one level, the largest of (budget -
    caps of the smaller ones) / (weights of the rest) in the order of cap / weight. Children of
    one ratio are one row there, so a node's window has narrow rows, one for each ratio.
    """
    leaves = leaves.withColumn("_top", F.lit(0))
    given = leaves.sparkSession.range(1).select(F.lit(0).alias("_top"), F.lit(budget).cast("bigint").alias("budget"))
    for level in range(1, len(weights) + 1):
        parent, own = ["_top", *names[: level - 1]], ["_top", *names[:level]]
        caps = leaves.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(own[-1], weights[level - 1]))
        caps = caps.withColumn("ratio", F.col("cap") / F.col("w"))
        steps = caps.groupBy(*parent, "ratio").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")).join(given, parent)
        order = Window.partitionBy(*parent).orderBy("ratio")
        smaller = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        filled = steps.withColumn("fill", (F.col("budget") - smaller).cast("double") / rest.cast("double"))
        filled = filled.groupBy(*parent).agg(F.greatest(F.max("fill"), F.lit(0.0)).alias("fill"))
        part = F.least("cap", F.floor(F.col("w") * F.col("fill")).cast("bigint"))
        given = written(caps.join(filled, parent).select(*own, part.alias("budget")), "mix-budgets")
    return given.drop("_top")


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, BLANKS), "")).cast("bigint")


def place(seed: int, epoch: Column) -> Column:
    """Where a document stands in an epoch's order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.md5("_text")))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping[str, int]],
    budget_share: float,
    max_epochs: int,
    seed: int = 0,
    id_column: str = "doc_id",
) -> DataFrame:
    """Rows of ``docs`` (once for each epoch that takes them), with ``_epoch``, ``_tokens`` and ``_leaf``.

    ``budget_share``: the budget as a share of all tokens of the corpus. Columns of the three
    names in the input are replaced.
    """
    names = list(levels)
    rows = docs.select(
        F.struct("*").alias("_row"), F.col(id_column).alias("_id"), text_of().alias("_text"),
        F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()]).alias("_leaf"),
    ).withColumn("_tokens", token_count(F.col("_text")))
    sums = written(rows.groupBy("_leaf").agg(F.sum("_tokens").alias("tokens")).select("_leaf.*", "tokens"), "mix-leaves")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = min(math.floor(total * budget_share), total * max_epochs)
    budgets = leaf_budgets(sums.withColumn("cap", F.col("tokens") * max_epochs), names, budget, weights)
    leaf = F.struct(*[F.col(n) for n in names]).alias("_leaf")
    empty = F.col("tokens") == 0
    whole = F.when(empty, max_epochs).otherwise(F.expr("budget div nullif(tokens, 0)")).cast("bigint")
    part = F.when(empty, 0).otherwise(F.expr("budget % nullif(tokens, 0)")).cast("bigint")
    plan = written(sums.join(budgets, names).select(leaf, whole.alias("_whole"), part.alias("_rest")), "mix-plan")
    plan = measured(plan, 200)

    # One row for each hash range of a leaf: the tokens that come before it in the last epoch.
    last = rows.join(plan, "_leaf").withColumn("_place", place(seed, F.col("_whole"))).withColumn("_bin", F.substring("_place", 1, BIN_DIGITS))
    bins = last.groupBy("_leaf", "_bin").agg(F.sum("_tokens").alias("n"))
    upto = Window.partitionBy("_leaf").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.withColumn("_before", F.sum("n").over(upto) - F.col("n")).join(plan, "_leaf").filter("_before <= _rest")
    ends = written(ends.groupBy("_leaf").agg(F.max(F.struct("_bin", "_before")).alias("_end")), "mix-ends")
    full_plan = measured(written(plan.join(ends, "_leaf", "left").select("_leaf", "_whole", "_rest", "_end"), "mix-plan"), 250)  # a row for each leaf

    planned = rows.join(full_plan, "_leaf").withColumn("_place", place(seed, F.col("_whole"))).withColumn("_bin", F.substring("_place", 1, BIN_DIGITS))
    edge = planned.filter(F.col("_bin") == F.col("_end._bin")).select("_leaf", "_place", "_tokens", "_rest", F.col("_end._before").alias("_before"))
    edge = edge.groupBy("_leaf", "_place").agg(F.sum("_tokens").alias("n"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    running = F.sum("n").over(Window.partitionBy("_leaf").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("_sum", F.col("_before") + running).filter("_sum <= _rest").select("_leaf", "_place", F.lit(True).alias("_fits"))
    edge = measured(written(edge, "mix-edge"), 200)
    # Beyond the measured size, the join spreads a leaf by the place within it.
    taken = planned.join(edge, ["_leaf", "_place"], "left")
    fits = (F.col("_bin") < F.col("_end._bin")) | F.coalesce(F.col("_fits"), F.lit(False))
    epochs = F.when(fits & (F.col("_whole") < max_epochs), F.col("_whole") + 1).otherwise(F.col("_whole"))
    chosen = taken.withColumn("_epochs", epochs).filter("_epochs > 0")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("_epoch", "_tokens", "_leaf")]
    return chosen.select(*kept, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_epochs") - 1)).alias("_epoch"), "_tokens", "_leaf")
