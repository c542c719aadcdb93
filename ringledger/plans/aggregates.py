"""Aggregations as queries (AG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringledger.operators import metrics, ranks, rules
from ringledger.operators.contests import collapse_sides, long_form
from ringledger.plans.base import CONTEST, HISTORY, LONG, PREDICTION, Module, contests, history, predictions, r6
from ringledger.sources.tables import table

M = Module()
query = M.query


@query("ag1_counts_in_one_pass", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS p FROM orders")
def ag1(spark, folder):
    s = F.col("o_orderstatus")
    return table(spark, folder, "orders").agg(F.count("*").alias("n"), F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(~s.isin("F", "O")).alias("p"))


@query("ag2_conditional_sums", "SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS won FROM orders GROUP BY 1")
def ag2(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("won"))


@query("ag3_group_by_coalesce", "SELECT coalesce(nullif(o_orderstatus, 'P'), 'live') AS kind, count(*) AS n FROM orders GROUP BY 1")
def ag3(spark, folder):
    return table(spark, folder, "orders").groupBy(F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("live")).alias("kind")).agg(F.count("*").alias("n"))


@query("ag4_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def ag4(spark, folder):
    return table(spark, folder, "orders").groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("ag5_two_keys_min_count", "SELECT o_custkey, o_orderstatus, min(o_orderdate) AS first, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS big FROM orders GROUP BY 1, 2")
def ag5(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").alias("first"), F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("big")).orderBy(F.col("first").desc_nulls_last())


@query("ag6_having_order_limit", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, o_custkey LIMIT 20")
def ag6(spark, folder):
    """The 20 most frequent keys: the limit is the feature."""
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 5").orderBy(F.desc("n"), "o_custkey").limit(20)


@query("ag7_distinct_unordered", "WITH " + CONTEST + " SELECT count(DISTINCT (least(a, b), greatest(a, b), d::DATE)) AS n FROM contest")
def ag7(spark, folder):
    return contests(spark, folder).agg(F.countDistinct(F.struct(F.least("a", "b"), F.greatest("a", "b"), F.to_date("d"))).alias("n"))


@query("ag8_distinct_and_count", "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def ag8(spark, folder):
    return table(spark, folder, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"))


@query("ag9_profile", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS keys, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def ag9(spark, folder):
    return table(spark, folder, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.countDistinct("o_custkey").alias("keys"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("ag11_average_by_joined_kind", "SELECT c_mktsegment, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1")
def ag11(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, folder, "orders").filter("o_totalprice > 1000").join(c, "o_custkey").groupBy("c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("ag12_top_keys_per_kind", "SELECT o_orderpriority, o_custkey, n FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) <= 10")
def ag12(spark, folder):
    n = table(spark, folder, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("n"), "o_custkey"))
    return n.withColumn("rank", rank).filter("rank <= 10").drop("rank")


@query("ag13_label_and_result", "WITH " + HISTORY + " SELECT CASE WHEN value > 150000 THEN 'big' ELSE 'small' END AS label, result, count(*) AS n FROM history GROUP BY 1, 2")
def ag13(spark, folder):
    return history(spark, folder).groupBy(F.when(F.col("value") > 150000, "big").otherwise("small").alias("label"), "result").agg(F.count("*").alias("n"))


@query("ag15_top_categories", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 20")
def ag15(spark, folder):
    """A top-20 list: the limit is the feature."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(n, "c_nationkey").select("n_name", "n").orderBy(F.desc("n"), "n_name").limit(20)


@query("ag16_many_aggregates_two_keys", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 3) AS quantity, round(avg(l_discount), 3) AS discount, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2")
def ag16(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 3).alias("quantity"), F.round(F.avg("l_discount"), 3).alias("discount"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("ag17_edge_on_both_sides", "WITH " + LONG + " SELECT entity, count(*) AS n, round(avg(won::INT), 6) AS rate, round(avg(won::INT) - 0.5, 6) AS edge FROM side GROUP BY 1 HAVING count(*) >= 20")
def ag17(spark, folder):
    won = F.avg(F.col("won").cast("int"))
    return long_form(contests(spark, folder)).groupBy("entity").agg(F.count("*").alias("n"), r6(won).alias("rate"), r6(won - 0.5).alias("edge")).filter("n >= 20")


@query("ag19_breakdown_grouping_sets", "WITH " + PREDICTION + """, t AS (SELECT *, CASE WHEN p >= 0.70 THEN 'high' WHEN p >= 0.60 THEN 'medium' WHEN p >= 0.55 THEN 'low' ELSE 'toss-up' END AS tier FROM prediction),
x AS (SELECT 'tier' AS kind, tier AS value, won FROM t UNION ALL SELECT 'kind', kind, won FROM t UNION ALL SELECT 'all', NULL, won FROM t)
SELECT kind, value, count(*) AS n, sum(won::INT)::BIGINT AS correct, round(avg(won::INT), 6) AS accuracy FROM x GROUP BY 1, 2""")
def ag19(spark, folder):
    rows = predictions(spark, folder).withColumn("tier", metrics.tier(F.col("p")))
    return metrics.breakdown(rows, ["tier", "kind"]).withColumn("accuracy", r6("accuracy"))


@query("ag20_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def ag20(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("ag21_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def ag21(spark, folder):
    return table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("ag22_missing_per_column", """WITH t AS (SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a, nullif(c_mktsegment, 'BUILDING') AS b, c_custkey AS c FROM customer)
SELECT 'a' AS name, count(*) FILTER (a IS NULL) AS missing, round(100.0 * count(*) FILTER (a IS NULL) / count(*), 6) AS percent FROM t UNION ALL SELECT 'b', count(*) FILTER (b IS NULL), round(100.0 * count(*) FILTER (b IS NULL) / count(*), 6) FROM t UNION ALL SELECT 'c', count(*) FILTER (c IS NULL), round(100.0 * count(*) FILTER (c IS NULL) / count(*), 6) FROM t""")
def ag22(spark, folder):
    rows = table(spark, folder, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("a"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("b"), F.col("c_custkey").alias("c"))
    return metrics.missing(rows, ["a", "b", "c"]).withColumn("percent", r6("percent"))


@query("ag23_coverage", "SELECT count(*) AS n, count(k) AS covered, round(100.0 * count(k) / count(*), 6) AS percent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 250000) ON c_custkey = k")
def ag23(spark, folder):
    return rules.coverage(table(spark, folder, "customer"), table(spark, folder, "orders").filter("o_totalprice > 250000"), "c_custkey", "o_custkey").withColumn("percent", r6("percent"))


@query("ag24_ag25_deviations", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sample, round(stddev_pop(o_totalprice), 4) AS population FROM orders GROUP BY 1")
def ag24(spark, folder):
    x = "o_totalprice"
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sample"), F.round(F.stddev_pop(x), 4).alias("population"))


@query("ag26_ag27_percentiles", "SELECT round(quantile_cont(o_totalprice, 0.01), 6) AS lo, round(quantile_cont(o_totalprice, 0.99), 6) AS hi, round(median(o_totalprice), 6) AS mid FROM orders")
def ag26(spark, folder):
    x = "o_totalprice"
    found = ranks.percentiles(table(spark, folder, "orders"), {"lo": (x, 0.01), "hi": (x, 0.99), "mid": (x, 0.5)})
    return found.select(*(r6(c).alias(c) for c in found.columns))


@query("ag28_correlations", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def ag28(spark, folder):
    return metrics.correlations(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", r6("r"))


@query("ag29_slope", "SELECT o_custkey, round(regr_slope(o_totalprice, n), 4) AS slope FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) GROUP BY 1 HAVING count(*) > 2")
def ag29(spark, folder):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, folder, "orders").withColumn("n", n).groupBy("o_custkey").agg(F.round(F.regr_slope("o_totalprice", "n"), 4).alias("slope"), F.count("*").alias("k"))
    return rows.filter("k > 2").select("o_custkey", "slope")


@query("ag30_calibration_error", "WITH " + PREDICTION + ", b AS (SELECT least(9, floor(p * 10)) AS bin, avg(p) AS x, avg(won::INT) AS y, count(*) AS n FROM prediction GROUP BY 1) SELECT round(sum(abs(x - y) * n) / sum(n), 6) AS ece, CASE WHEN sum(abs(x - y) * n) / sum(n) > 0.10 THEN 'poor' WHEN sum(abs(x - y) * n) / sum(n) > 0.05 THEN 'moderate' ELSE 'good' END AS verdict FROM b")
def ag30(spark, folder):
    return metrics.calibration_error(predictions(spark, folder), y="won").withColumn("ece", r6("ece"))


@query("ag31_reliability_bins", "WITH " + PREDICTION + " SELECT least(9, floor(p * 10))::INT AS bin, round(avg(p), 6) AS predicted, round(avg(won::INT), 6) AS actual, count(*) AS n, round(abs(avg(p) - avg(won::INT)), 6) AS error FROM prediction GROUP BY 1")
def ag31(spark, folder):
    out = metrics.bins(predictions(spark, folder), y="won")
    return out.select("bin", r6("predicted").alias("predicted"), r6("actual").alias("actual"), "n", r6("error").alias("error"))


@query("ag34_record_by_opponent_kind", "WITH " + LONG + " SELECT entity, opponent % 4 AS style, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, round(avg(won::INT), 6) AS win_rate FROM side GROUP BY 1, 2")
def ag34(spark, folder):
    won = F.col("won")
    return long_form(contests(spark, folder)).groupBy("entity", (F.col("opponent") % 4).alias("style")).agg(F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), r6(F.avg(won.cast("int"))).alias("win_rate"))


@query("ag35_tiered_quality", "WITH " + LONG + """ SELECT entity, sum(CASE WHEN s_acctbal >= 6000 THEN CASE WHEN won THEN 4 ELSE -1 END WHEN s_acctbal >= 3000 THEN CASE WHEN won THEN 3 ELSE -2 END WHEN s_acctbal >= 0 THEN CASE WHEN won THEN 2 ELSE -3 END ELSE CASE WHEN won THEN 1 ELSE -4 END END)::BIGINT AS index
FROM side JOIN supplier ON opponent = s_suppkey GROUP BY 1""")
def ag35(spark, folder):
    """Wins weigh more against better opponents, losses less."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("opponent"), F.col("s_acctbal").alias("x"))
    points = F.when(F.col("x") >= 6000, 4).when(F.col("x") >= 3000, 3).when(F.col("x") >= 0, 2).otherwise(1)
    return long_form(contests(spark, folder)).join(s, "opponent").groupBy("entity").agg(F.sum(F.when(F.col("won"), points).otherwise(points - 5)).alias("index"))


@query("ag36_career_shares", "WITH " + HISTORY + " SELECT entity, round(100.0 * count(*) FILTER (result = 'win' AND method = 'KO') / nullif(count(*) FILTER (result = 'win'), 0), 4) AS ko, round(100.0 * count(*) FILTER (method = 'DEC') / count(*), 4) AS decision, round(avg(value), 4) AS mean FROM history GROUP BY 1")
def ag36(spark, folder):
    win, m = F.col("result") == "win", F.col("method")
    ko = F.try_divide(100.0 * F.count_if(win & (m == "KO")), F.count_if(win))
    return history(spark, folder).groupBy("entity").agg(F.round(ko, 4).alias("ko"), F.round(100.0 * F.count_if(m == "DEC") / F.count("*"), 4).alias("decision"), F.round(F.avg("value"), 4).alias("mean"))


@query("ag37_two_sides_to_one", "WITH " + LONG + ", q AS (SELECT *, (entity % 10 + 1) / (entity % 10 + opponent % 10 + 2.0::DOUBLE) AS p FROM side) SELECT id, round(avg(CASE WHEN swapped THEN 1 - p ELSE p END), 6) AS p, max(CASE WHEN NOT swapped THEN won END) AS won FROM q GROUP BY 1")
def ag37(spark, folder):
    p = (F.col("entity") % 10 + 1) / (F.col("entity") % 10 + F.col("opponent") % 10 + 2.0)
    return collapse_sides(long_form(contests(spark, folder)).withColumn("p", p)).withColumn("p", r6("p"))


@query("ag38_peak", "WITH " + HISTORY + " SELECT entity, max(value) AS peak, arg_max(value, id) AS last FROM history GROUP BY 1")
def ag38(spark, folder):
    return history(spark, folder).groupBy("entity").agg(F.max("value").alias("peak"), F.max_by("value", "id").alias("last"))


@query("ag39_counters_by_kind", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, max(ts) AS last FROM events GROUP BY 1")
def ag39(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.max("ts").alias("last"))


@query("ag41_roi", "WITH " + PREDICTION + " SELECT kind, count(*) AS n, round(avg(won::INT), 6) AS rate, round(sum(CASE WHEN won THEN 1 / p - 1 ELSE -1 END) / count(*), 6) AS roi FROM prediction GROUP BY 1")
def ag41(spark, folder):
    profit = F.when(F.col("won"), 1 / F.col("p") - 1).otherwise(-1.0)
    return predictions(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg(F.col("won").cast("int"))).alias("rate"), r6(F.sum(profit) / F.count("*")).alias("roi"))


@query("ag42_roi_by_threshold", "WITH " + PREDICTION + " SELECT t AS threshold, count(*) AS n, round(sum(CASE WHEN won THEN 0.91::DOUBLE ELSE -1 END) / count(*), 6) AS roi FROM prediction, (VALUES (0.55::DOUBLE), (0.57), (0.60), (0.65), (0.70)) x(t) WHERE p >= t GROUP BY 1")
def ag42(spark, folder):
    profit = F.when(F.col("won"), 0.91).otherwise(-1.0)
    return metrics.by_threshold(predictions(spark, folder), "p", [0.55, 0.57, 0.60, 0.65, 0.70], [F.count("*").alias("n"), r6(F.sum(profit) / F.count("*")).alias("roi")])


@query("ag43_three_strategies", "WITH " + PREDICTION + " SELECT s AS strategy, count(*) AS n, round(sum(CASE WHEN won THEN 1 / p - 1 ELSE -1 END), 4) AS profit FROM prediction, (VALUES ('all', 0.5::DOUBLE), ('medium', 0.6), ('high', 0.7)) x(s, t) WHERE p >= t GROUP BY 1")
def ag43(spark, folder):
    plans = [("all", 0.5), ("medium", 0.6), ("high", 0.7)]
    reached = F.filter(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in plans)), lambda x: F.col("p") >= x["t"])
    profit = F.when(F.col("won"), 1 / F.col("p") - 1).otherwise(-1.0)
    return predictions(spark, folder).withColumn("x", F.explode(reached)).groupBy(F.col("x.s").alias("strategy")).agg(F.count("*").alias("n"), F.round(F.sum(profit), 4).alias("profit"))
