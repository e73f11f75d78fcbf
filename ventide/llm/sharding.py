"""Sharding by longest-processing-time scheduling.

Groups that must stay together are sorted by size, and each goes to the least-loaded shard, taken
from a heap. The heap sees a bounded list of items, whatever the table holds: a group larger than
a share of the total (1 / (shards x LARGE)) is an item of its own, of which there are fewer than
shards x LARGE; the smaller groups are dealt by the hash of their key into shards x BUNDLES
bundles, and a bundle is an item. The loads then differ by about the smallest bundle unless one
group alone exceeds a shard.

No group meets in one task: group sizes are partial sums, and slots are numbered in parts of a
shard that the hash of the row decides, each part beginning where the parts before it end. The
number of parts follows the counted rows.

Defined cases: a null text has size `overhead` and its rows form one group, apart from empty texts;
equal rows get different slots of one shard, in no particular order among them; an empty table gives
an empty result; clashing columns are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide.llm.tables import stored

LARGE, BUNDLES, PART_ROWS = 256, 64, 20_000
ADDED = ("shard", "slot")


def schedule(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest first to the least loaded; of equal loads the lowest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign(rows: DataFrame, *, size: str, group: Column, order: Column, shards: int = 40) -> DataFrame:
    """The rows with `shard` and `slot` (gapless from 0 in each shard).

    `group` names the rows that must stay together (a digest, if it is long); `order` spreads the rows of one shard over the
    parts in which slots are numbered.
    """
    spark = rows.sparkSession
    base = rows.drop(*ADDED).withColumn("_group", F.coalesce(group.cast("string"), F.lit("")))
    base = stored(base.withColumn("_draw", F.xxhash64(order)), "shard-rows")
    total = base.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return base.select(*(c for c in base.columns if c[0] != "_"), F.lit(0).alias("shard"),
                           F.lit(0).cast("long").alias("slot"))
    groups = base.groupBy("_group").agg(F.sum(size).alias("_sum"))
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("_group"), F.lit(shards * BUNDLES)).cast("string"))
    own = F.col("_sum") * shards * LARGE > F.lit(total["bytes"])
    groups = stored(groups.withColumn("_item", F.when(own, F.col("_group")).otherwise(bundle)), "shard-groups")
    items = groups.groupBy("_item").agg(F.sum("_sum").alias("_sum")).collect()  # fewer than shards x (LARGE + BUNDLES)
    placed = schedule([(r["_item"], r["_sum"]) for r in items], shards)
    table = spark.createDataFrame(list(placed.items()), "_item string, shard int")
    # At most 40 x 320 items, whatever the input: safe to broadcast.
    where = groups.select("_group", "_item").join(F.broadcast(table), "_item").drop("_item")
    parts = max(1, -(-total["rows"] // (shards * PART_ROWS)))
    part = F.pmod(F.col("_draw"), F.lit(parts)).cast("int")
    placed_rows = stored(base.join(where, "_group").withColumn("_part", part), "shard-placed")
    counts = placed_rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"),
                                  F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin")), "shard-parts")
    inside = Window.partitionBy("shard", "_part").orderBy("_draw")
    numbered = placed_rows.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        numbered.join(begins, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
        .withColumn("slot", (F.col("_row") + F.col("_begin")).cast("long"))
        .select(*(c for c in rows.columns if c.lower() not in ADDED), "shard", "slot")
    )
