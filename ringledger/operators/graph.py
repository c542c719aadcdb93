"""Connected components of links by star contraction: distributed union-find for graphs of any size.

Each round hooks the neighbours of a node to the smallest node next to it, first the larger ones, then the smaller ones
and the node itself; rounds end at one star around each component's smallest node. A node's smallest neighbour is an
aggregate, so that it is reduced before any shuffle. Before the first round each partition drops the links that close a
cycle within it, so that rounds work on links in proportion to the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.sources.files import stored


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's links u, v those that join what the ones before left apart: no more than it has nodes."""
    up: dict = {}

    def root(x: object) -> object:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        keep = []
        for u, v in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            fresh = u not in up
            x, y = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            keep.append(x != y or (fresh and u == v))
            up[x] = y
        yield batch.filter(pa.array(keep, pa.bool_()))


def _hooked(links: DataFrame) -> DataFrame:
    """links: u, v. Gives u, v and m, the smallest of u and its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return links.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of a link, also of a link to itself."""
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("v is not null")
    every = stored(ends.mapInArrow(forest, ends.schema).distinct())
    now, seen = every.filter("u != v"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = _hooked(large)
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = every.filter("u = v").select(F.col("u").alias("node")).join(now.select(F.col("u").alias("node")).unionByName(hubs.select("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(hubs).unionByName(alone.select("node", F.col("node").alias("root")))
