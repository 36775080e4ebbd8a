"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_left_join


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the links (a, b).

    Rounds of large-star and small-star links (Kiveris et al. 2014), each cut to the checkpoint folder. A node's
    minimum is pre-aggregated and joined back salted, so a node with very many links is spread over tasks. Links to
    itself and repeated links don't matter; no links give no rows. Rounds that don't settle the labels are an error.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(links.filter(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if new["n"] == 0 or new == mark:
            break
        mark, now = new, cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    return leaves.union(now.select("u", "u").distinct().toDF("node", "component")).groupBy("node").agg(F.min("component").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = links.select("v", "u").union(links.select(F.col("u"), F.col("v")))  # v sees u
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    seen = salted_left_join(both.filter("u > v"), least, ["v"], F.col("u"))
    return seen.select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the least of them. All links go down already."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    seen = salted_left_join(links, least, ["v"], F.col("u")).filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return seen.union(least).distinct()
