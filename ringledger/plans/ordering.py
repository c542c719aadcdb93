"""Sorts, limits, samples, splits, set operations and reshaping as queries (SO, ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringledger.operators import splits
from ringledger.operators.contests import long_form
from ringledger.plans.base import CONTEST, HISTORY, LONG, PREDICTION, Module, contests, history, predictions
from ringledger.sources.tables import table

M = Module()
query = M.query
NUMBERED = "n AS (SELECT *, row_number() OVER (ORDER BY d, id) AS n, count(*) OVER () AS total FROM prediction)"


@query("so1_nulls_last_mixed", "SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS x FROM customer) ORDER BY x DESC NULLS LAST, c_custkey LIMIT 50")
def so1(spark, folder):
    """The first fifty in order: the limit is the feature."""
    x = F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal")).alias("x")
    return table(spark, folder, "customer").select("c_custkey", x).orderBy(F.col("x").desc_nulls_last(), "c_custkey").limit(50)


@query("so2_case_priority", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderpriority = '2-HIGH' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 1")
def so2(spark, folder):
    """The best row by priority: the limit is the feature."""
    p = F.when(F.col("o_orderpriority") == "2-HIGH", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return table(spark, folder, "orders").orderBy(p, F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey")


@query("so4_largest", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def so4(spark, folder):
    """The ten largest: the limit is the feature."""
    return table(spark, folder, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select("s_suppkey", "s_acctbal")


@query("so5_head_and_tail", "(SELECT s_suppkey, 'low' AS side FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5) UNION ALL (SELECT s_suppkey, 'high' FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)")
def so5(spark, folder):
    """Both ends of an order: the limits are the feature."""
    s = table(spark, folder, "supplier")
    low, high = s.orderBy("s_acctbal", "s_suppkey").limit(5), s.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5)
    return low.select("s_suppkey", F.lit("low").alias("side")).unionByName(high.select("s_suppkey", F.lit("high").alias("side")))


@query("so6_chronological", "WITH " + CONTEST + " SELECT id, d FROM contest")
def so6(spark, folder):
    return contests(spark, folder).select("id", "d").orderBy("d", "id")


@query("so8_split_80_20", "WITH " + PREDICTION + ", " + NUMBERED + " SELECT id, CASE WHEN n <= floor(total * 0.8) THEN 'train' ELSE 'test' END AS part FROM n")
def so8(spark, folder):
    return splits.by_position(predictions(spark, folder), ["d", "id"], [("train", 0.8), ("test", 1.0)]).select("id", "part")


@query("so9_split_by_contest", "WITH " + CONTEST + ", n AS (SELECT *, row_number() OVER (ORDER BY d, id) AS n, count(*) OVER () AS total FROM contest), p AS (SELECT *, CASE WHEN n <= floor(total * 0.7) THEN 'train' WHEN n <= floor(total * 0.85) THEN 'val' ELSE 'holdout' END AS part FROM n) SELECT part, 2 * count(*) AS rows, min(d) AS first, max(d) AS last FROM p GROUP BY 1")
def so9(spark, folder):
    """Split by contest, so that both sides' rows fall into one part."""
    part = splits.by_position(contests(spark, folder), ["d", "id"], [("train", 0.7), ("val", 0.85), ("holdout", 1.0)]).select("id", "part")
    return long_form(contests(spark, folder)).join(part, "id").groupBy("part").agg(F.count("*").alias("rows"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("so10_split_assertions", "SELECT 0::BIGINT AS shared, true AS in_order")
def so10(spark, folder):
    parts = splits.by_position(predictions(spark, folder), ["d", "id"], [("train", 0.8), ("test", 1.0)])
    shared = parts.groupBy("id").agg(F.countDistinct("part").alias("k")).agg(F.count_if(F.col("k") > 1).alias("shared"))
    order = parts.agg((F.max(F.when(F.col("part") == "train", F.col("d"))) <= F.min(F.when(F.col("part") == "test", F.col("d")))).alias("in_order"))
    return shared.join(order, F.lit(True))


@query("so11_time_folds", "WITH " + PREDICTION + ", " + NUMBERED + ", b AS (SELECT *, CASE WHEN n <= floor(total * (1/6::DOUBLE)) THEN 1 WHEN n <= floor(total * (2/6::DOUBLE)) THEN 2 WHEN n <= floor(total * (3/6::DOUBLE)) THEN 3 WHEN n <= floor(total * (4/6::DOUBLE)) THEN 4 WHEN n <= floor(total * (5/6::DOUBLE)) THEN 5 ELSE 6 END AS block FROM n) SELECT block, count(*) AS n FROM b GROUP BY 1")
def so11(spark, folder):
    return splits.folds(predictions(spark, folder), ["d", "id"], 5).groupBy("block").agg(F.count("*").alias("n"))


@query("so12_hash_sample", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 200")
def so12(spark, folder):
    """A sample of 200: sampling is the feature."""
    return splits.hash_sample(table(spark, folder, "orders"), "o_orderkey", 200).select("o_orderkey")


@query("so13_bootstrap")
def so13(spark, folder):
    from ringledger.operators import stats

    rows = predictions(spark, folder).withColumn("hit", ((F.col("p") >= 0.6) == F.col("won")).cast("double"))
    return stats.bootstrap(rows, "hit", "id", replicates=1000)


@query("st1_union_of_sides", "WITH " + LONG + " SELECT entity, count(*) AS n, count(*) FILTER (won) AS wins FROM side GROUP BY 1")
def st1(spark, folder):
    return long_form(contests(spark, folder)).groupBy("entity").agg(F.count("*").alias("n"), F.count_if("won").alias("wins"))


@query("st3_swap_by_hash", "WITH " + CONTEST + " SELECT id, CASE WHEN substr(md5('42|' || id), 1, 1) < '8' THEN b ELSE a END AS first FROM contest")
def st3(spark, folder):
    swap = splits.swapped_by_hash("id")
    return contests(spark, folder).select("id", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("first"))


@query("st4_concat_frames", "SELECT s_suppkey AS k, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def st4(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("st5_set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'any', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)")
def st5(spark, folder):
    c, o = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")), table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    out = None
    for kind, rows in (("both", c.intersect(o)), ("only", c.subtract(o)), ("any", c.union(o).distinct())):
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("st6_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def st6(spark, folder):
    return table(spark, folder, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("st8_nested_groups", "SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def st8(spark, folder):
    """The feature is a list for each key."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("keys"))


@query("st9_dictionary_merge", "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(c_acctbal, s_acctbal) AS v FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def st9(spark, folder):
    x = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    y = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"))
    return x.join(y, "k", "full_outer").select("k", F.coalesce("y", "x").alias("v"))


@query("st10_flatten_map", "SELECT o_custkey, o_orderkey FROM orders")
def st10(spark, folder):
    nested = table(spark, folder, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("m"))
    return nested.select("o_custkey", F.explode("m").alias("o_orderkey", "v")).select("o_custkey", "o_orderkey")


@query("st2_explode_orientations", "WITH " + HISTORY + " SELECT id, x AS swapped, CASE WHEN x THEN result <> 'win' ELSE result = 'win' END AS target FROM history, (VALUES (false), (true)) v(x)")
def st2(spark, folder):
    rows = history(spark, folder).select("id", "result", F.explode(F.array(F.lit(False), F.lit(True))).alias("swapped"))
    return rows.select("id", "swapped", F.when(F.col("swapped"), F.col("result") != "win").otherwise(F.col("result") == "win").alias("target"))


