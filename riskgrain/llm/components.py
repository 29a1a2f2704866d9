"""Connected components of an edge table, without holding links, labels or components on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.llm.common import settle, unsettle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step on edges (u > v): hang neighbours on the smallest node seen.

    ``large``: every larger neighbour of a node moves to the least of the node and its neighbours. Else: a node and its
    smaller neighbours move to the least of them.
    """
    seen = edges.select("u", "v")
    if large:
        seen = seen.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    joined = seen.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("least").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edge table (a, b).

    Alternates large-star and small-star steps until every tree is a star, which takes a number of rounds that grows
    with the logarithm of the longest path. Each round is two aggregations with map-side combine and two joins that
    adaptive execution may split, and is written to the shared folder. Nodes without edges do not appear; loops and null ends are
    ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = settle(now)
    while True:
        # done when all trees are stars: no child has two parents and no parent is a child
        ends = now.groupBy("u").agg(F.count("*").alias("parents"), F.lit(0).alias("children"))
        tops = now.groupBy(F.col("v").alias("u")).agg(F.lit(0).alias("parents"), F.count("*").alias("children"))
        both = ends.unionByName(tops).groupBy("u").agg(F.sum("parents").alias("parents"), F.sum("children").alias("children"))
        if both.where("parents > 1 or (parents > 0 and children > 0)").limit(1).count() == 0:
            break
        after = settle(_star(_star(now, True), False))
        unsettle(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
