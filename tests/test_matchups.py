"""Pairs of a group by blocks, beside all pairs by loops."""

import random

from pyspark.sql import functions as F

from ringledger.operators import matchups


def test_pairs_of_a_large_group(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 1, 1, 2, None]), r.random()) for i in range(120)] + [(None, 1, 0.5), (500, 7, 1.0)]
    made = matchups.pairs(spark.createDataFrame(rows, "k long, g int, x double"), "k", "g", block=10)
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in (a[0], b[0], a[1]) and a[1] == b[1] and a[0] < b[0])
    assert made.columns == ["a_k", "a_g", "a_x", "b_k", "b_g", "b_x"]
    assert sorted(map(tuple, made.select("a_k", "b_k").collect())) == want


def test_no_task_makes_all_pairs_of_a_group(spark):
    one = spark.range(4000).select(F.col("id").alias("k"), F.lit(1).alias("g"))
    made = matchups.pairs(one, "k", "g", block=250).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(x["count"] for x in made) == 4000 * 3999 // 2 and max(x["count"] for x in made) < 4000 * 3999 // 16
