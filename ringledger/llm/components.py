"""Connected components of links by star contraction: distributed union-find for graphs of any size.

Large-star hooks every larger neighbour of a node to the smallest node next to it; small-star does the same with the
smaller neighbours and the node itself. In turns, they end at one star around each component's smallest node. Minima
are pre-aggregated before any shuffle, so that a hub with very many links costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import stored


def _star(links: DataFrame) -> DataFrame:
    """links: u, v. Gives (v, m) with m the smallest of u and its v's."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return links.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of a link. Nodes are of any type that can be ordered."""
    now = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _star(large)
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = stored(hooked.filter("u != v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
