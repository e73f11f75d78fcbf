"""Connected components of links between documents, by alternating star contraction.

Each round rewires every node to the smallest neighbour it knows, first from the larger side and
then from the smaller one; the number of rounds grows with the logarithm of a component's extent.
A node with very many links is a hot join key that Spark splits; minima are partial aggregates.
Links are written to the shared folder after each round and never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide.llm.tables import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node u the smallest of itself and its neighbours v."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")


def components(links: DataFrame) -> DataFrame:
    """`links` has two integer columns. Returns id and component (the smallest id reachable) for
    every id that has a link to another; null and self links are ignored."""
    a, b = links.columns
    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct(), "links")
    state = None
    while True:
        known = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(known) == state or not known["n"]:
            break
        state = tuple(known)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.where("v > u").join(_smallest(both), F.col("u") == F.col("_u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = stored(large, "links-large")
        low = _smallest(large)
        small = large.join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(
            small.unionByName(low.select(F.col("_u").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct(), "links")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
