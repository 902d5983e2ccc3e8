"""Resharding with the fewest bytes moved.

Documents lie in old shards. Blocks, hash ranges of a shard, are what is moved. From the
old shards' bytes and the new shards' capacities a minimum-cost flow (staying is free, a
byte moved costs one) tells how many bytes go from where to where; whole blocks are then
dealt to meet these amounts, the largest first, each to the target that lacks most. New
shards that lose or gain nothing keep their old files; the others are rewritten, each
file holding a range of slots.

The driver sees one row for each block, at most old shards x ``BLOCKS``.

Nulls: a null text has no bytes; a document's size is its bytes plus 1. A null old shard
is shard 0. Rows that agree in doc_id and text lie in the same block; their slots follow
each other. Other columns pass through unchanged; ``shard`` and ``slot`` are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import shared_folder, text_of

BLOCKS = 1024


def size_of() -> Column:
    return F.octet_length(text_of()).cast("bigint") + 1


def least_moves(sizes: dict[int, int], capacities: dict[int, int]) -> dict[tuple[int, int], int]:
    """Amounts from old to new shards with the fewest bytes moved: successive cheapest paths.

    Nodes are the old and the new shards; an edge between shards of one number costs 0,
    any other 1. Each round finds a cheapest path from a shard with bytes left to one
    with room (Bellman-Ford, over edges and their reversals) and fills it.
    """
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = dict(sizes), dict(capacities)
    cost = lambda i, j: 0 if i == j else 1
    while any(left.values()):
        best: dict[tuple[str, int], tuple[int, tuple | None]] = {("old", i): (0, None) for i, n in left.items() if n}
        for _ in range(len(sizes) + len(capacities)):
            changed = False
            for i in sizes:
                for j in capacities:
                    a, b = ("old", i), ("new", j)
                    if a in best and (b not in best or best[a][0] + cost(i, j) < best[b][0]):
                        best[b], changed = (best[a][0] + cost(i, j), a), True
                    if flow[i, j] and b in best and (a not in best or best[b][0] - cost(i, j) < best[a][0]):
                        best[a], changed = (best[b][0] - cost(i, j), b), True
            if not changed:
                break
        goal = min((j for j in capacities if room[j] and ("new", j) in best), key=lambda j: (best["new", j][0], j))
        path, node = [], ("new", goal)
        while best[node][1] is not None:
            path.append((best[node][1], node))
            node = best[node][1]
        amount = min([left[node[1]], room[goal], *(flow[b[1], a[1]] for a, b in path if a[0] == "new")])
        for a, b in path:
            if a[0] == "old":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[node[1]] -= amount
        room[goal] -= amount
    return {k: v for k, v in flow.items() if v}


def deal_blocks(blocks: dict[tuple[int, int], int], flow: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """The new shard of every block: large blocks first, to the target that lacks most."""
    lacks: dict[int, dict[int, int]] = defaultdict(dict)
    for (old, new), amount in flow.items():
        lacks[old][new] = amount
    dealt = {}
    for (old, block), size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        target = max(lacks[old], key=lambda j: (lacks[old][j], j == old, -j))
        dealt[old, block] = target
        lacks[old][target] -= size
    return dealt


def capacities_of(total: int, shards: int) -> dict[int, int]:
    return {j: total * (j + 1) // shards - total * j // shards for j in range(shards)}


def reshard(docs: DataFrame, old_shard: Column, shards: int, blocks: int = BLOCKS) -> tuple[str, DataFrame]:
    """Move blocks and rewrite the files of every shard that loses or gains one.

    Returns the folder of the rewritten shards and all documents with ``shard`` and
    ``slot`` (0, 1, ... within a shard), rewritten ones read from the new files and
    others from where they were. The texts cross the network once.
    """
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(
        F.struct("*").alias("_row"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("_old"), block.alias("_block"),
        F.xxhash64("text").alias("_tie"), F.col("doc_id").alias("_id"), size_of().alias("_size"),
    )
    listed = rows.groupBy("_old", "_block").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
    sizes: dict[int, int] = defaultdict(int)
    for r in listed:
        sizes[r["_old"]] += r["bytes"]
    flow = least_moves(sizes, capacities_of(sum(sizes.values()), shards))
    dealt = deal_blocks({(r["_old"], r["_block"]): r["bytes"] for r in listed}, flow)
    touched = {k for (i, _), j in dealt.items() if i != j for k in (i, j)}
    first, plan = defaultdict(int), []
    for r in sorted(listed, key=lambda r: (r["_old"], r["_block"])):
        shard = dealt[r["_old"], r["_block"]]
        plan.append((r["_old"], r["_block"], shard, first[shard], shard in touched))
        first[shard] += r["rows"]
    table = spark.createDataFrame(plan, "_old int, _block int, _shard int, _first bigint, _touched boolean")
    planned = rows.drop("_size").join(F.broadcast(table), ["_old", "_block"])  # at most one row a block

    within = Window.partitionBy("_shard", "_old", "_block").orderBy(F.asc_nulls_last("_id"), "_tie")
    columns = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]

    def numbered(some: DataFrame) -> DataFrame:
        at = some.repartitionByRange("_shard", "_old", "_block").withColumn("_at", F.row_number().over(within))
        return at.select(*columns, (F.col("_first") + F.col("_at") - 1).alias("slot"), F.col("_shard").alias("shard"))

    folder = shared_folder(spark, "shards")
    affected = numbered(planned.filter("_touched"))
    affected.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    result = spark.read.schema(affected.schema).parquet(folder)
    if set(first) - touched:
        result = result.unionByName(numbered(planned.filter("NOT _touched")))
    return folder, result
