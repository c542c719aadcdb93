"""Ordered histories as queries (WN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringledger.operators import history as H
from ringledger.operators import keyed, ranks
from ringledger.operators.contests import first_of_pair, long_form, ordered
from ringledger.plans.base import CONTEST, HISTORY, LONG, Module, contests, history, r6
from ringledger.sources.tables import table

M = Module()
query = M.query
O = "OVER (PARTITION BY entity ORDER BY d, id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
ALL, THREE, FIVE = O.format("UNBOUNDED"), O.format(3), O.format(5)
FIN = "avg(CASE WHEN result = 'win' AND method IN ('KO', 'SUB') THEN 1.0::DOUBLE ELSE 0 END) "


@query("wn1_last_means", "WITH " + HISTORY + f" SELECT id, round(avg(value) {THREE}, 6) AS mean3, round(avg(value) {FIVE}, 6) AS mean5 FROM history")
def wn1(spark, folder):
    return H.features(history(spark, folder)).select("id", r6("mean3").alias("mean3"), r6("mean5").alias("mean5"))


@query("wn2_last_max", "WITH " + HISTORY + f" SELECT id, max(value) {FIVE} AS max5 FROM history")
def wn2(spark, folder):
    return H.features(history(spark, folder)).select("id", "max5")


@query("wn3_last_changes", "WITH " + HISTORY + f", c AS (SELECT *, value - lag(value) OVER (PARTITION BY entity ORDER BY d, id) AS change FROM history) SELECT id, round(sum(change) {THREE}, 6) AS change_sum3, round(avg(change) {THREE}, 6) AS change_mean3 FROM c")
def wn3(spark, folder):
    return H.features(history(spark, folder)).select("id", r6("change_sum3").alias("change_sum3"), r6("change_mean3").alias("change_mean3"))


@query("wn4_finish_rates", "WITH " + HISTORY + f" SELECT id, round({FIN}{THREE}, 6) AS finish3, round({FIN}{FIVE}, 6) AS finish5 FROM history")
def wn4(spark, folder):
    return H.features(history(spark, folder)).select("id", r6("finish3").alias("finish3"), r6("finish5").alias("finish5"))


CAREER = f"coalesce(sum(CASE WHEN result = 'win' AND method IN ('KO', 'SUB') THEN 1 ELSE 0 END) {ALL} / nullif(sum(CASE WHEN result = 'win' THEN 1 ELSE 0 END) {ALL}, 0), 0)"


@query("wn5_career_finish_rate", "WITH " + HISTORY + f" SELECT id, round({CAREER}, 6) AS finish_career FROM history")
def wn5(spark, folder):
    return H.features(history(spark, folder)).select("id", r6("finish_career").alias("finish_career"))


@query("wn6_trends", "WITH " + HISTORY + f" SELECT id, round({FIN}{FIVE} - {CAREER}, 6) AS finish_trend, CASE WHEN count(*) {ALL} >= 6 THEN round(avg(value) {THREE} - avg(value) OVER (PARTITION BY entity ORDER BY d, id ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING), 6) END AS value_trend FROM history")
def wn6(spark, folder):
    return H.features(history(spark, folder)).select("id", r6("finish_trend").alias("finish_trend"), r6("value_trend").alias("value_trend"))


@query("wn7_has_prior", "WITH " + HISTORY + " SELECT id, row_number() OVER (PARTITION BY entity ORDER BY d, id) > 1 AS has_prior FROM history")
def wn7(spark, folder):
    return H.features(history(spark, folder)).select("id", "has_prior")


STREAKS = """n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, id) AS n FROM history)
SELECT x.id, (x.n - 1 - coalesce((SELECT max(y.n) FROM n y WHERE y.entity = x.entity AND y.n < x.n AND y.result <> 'win'), 0))::BIGINT AS win_streak,
(x.n - 1 - coalesce((SELECT max(y.n) FROM n y WHERE y.entity = x.entity AND y.n < x.n AND y.result <> 'loss'), 0))::BIGINT AS loss_streak FROM n x"""


@query("wn8_streaks", "WITH " + HISTORY + ", " + STREAKS)
def wn8(spark, folder):
    return H.features(history(spark, folder)).select("id", "win_streak", "loss_streak")


@query("wn9_feature_row", "WITH " + HISTORY + f" SELECT id, entity, round(avg(value) {THREE}, 6) AS mean3, max(value) {FIVE} AS max5, round({FIN}{THREE}, 6) AS finish3, round({CAREER}, 6) AS finish_career, row_number() OVER (PARTITION BY entity ORDER BY d, id) > 1 AS has_prior FROM history")
def wn9(spark, folder):
    return H.features(history(spark, folder)).select("id", "entity", r6("mean3").alias("mean3"), "max5", r6("finish3").alias("finish3"), r6("finish_career").alias("finish_career"), "has_prior")


@query("wn10_both_sides", "WITH " + LONG + " SELECT id, entity, opponent, won, swapped FROM side")
def wn10(spark, folder):
    return long_form(contests(spark, folder)).select("id", "entity", "opponent", "won", "swapped")


@query("wn11_recomputed", "WITH " + HISTORY + f" SELECT entity, id, count(*) {ALL} AS n_before, round(avg(value) {THREE}, 6) AS mean3 FROM history")
def wn11(spark, folder):
    return H.recompute(history(spark, folder)).withColumn("mean3", r6("mean3"))


@query("wn12_leakage_audit", "SELECT count(*) AS n, 0::BIGINT AS mismatches FROM orders")
def wn12(spark, folder):
    """Window features against the self-join: no row may differ by more than 0.02."""
    h = history(spark, folder)
    stored = H.features(h).select("entity", "id", F.col("mean3").alias("stored"))
    both = stored.join(H.recompute(h).select("entity", "id", "mean3"), ["entity", "id"])
    off = (F.col("stored").isNull() != F.col("mean3").isNull()) | (F.abs(F.col("stored") - F.col("mean3")) > 0.02)
    return both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(off, F.lit(False))).alias("mismatches"))


PIT = "one AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY entity, d::DATE ORDER BY d, id) = 1)"


@query("wn13_point_in_time_totals", "WITH " + HISTORY + ", " + PIT + f" SELECT id, count(*) {ALL} AS n_before, coalesce(sum((result = 'win')::INT) {ALL}, 0)::BIGINT AS wins, coalesce(sum((result = 'loss')::INT) {ALL}, 0)::BIGINT AS losses, round(coalesce(sum(value) {ALL}, 0), 4) AS value_sum FROM one")
def wn13(spark, folder):
    return H.point_in_time(history(spark, folder)).select("id", "n_before", "wins", "losses", F.round("value_sum", 4).alias("value_sum"))


@query("wn14_recent_form", "WITH " + HISTORY + ", " + PIT + f" SELECT id, round(coalesce(avg((result = 'win')::INT) {ALL}, 0.5), 6) AS win_rate, round(coalesce(avg((result = 'win')::INT) {THREE}, 0.5), 6) AS recent3 FROM one")
def wn14(spark, folder):
    return H.point_in_time(history(spark, folder)).select("id", r6("win_rate").alias("win_rate"), r6("recent3").alias("recent3"))


@query("wn15_first_of_day", "WITH " + HISTORY + ", " + PIT + " SELECT entity, id FROM one")
def wn15(spark, folder):
    return H.point_in_time(history(spark, folder)).select("entity", "id")


@query("wn17_form_decay", "WITH " + HISTORY + ", s AS (SELECT *, CASE result WHEN 'win' THEN 0.02::DOUBLE WHEN 'loss' THEN -0.02 ELSE 0 END AS x FROM history) SELECT id, round(coalesce(lag(x, 1) OVER w, 0) + coalesce(lag(x, 2) OVER w, 0) / 2 + coalesce(lag(x, 3) OVER w, 0) / 3, 6) AS form FROM s WINDOW w AS (PARTITION BY entity ORDER BY d, id)")
def wn17(spark, folder):
    x = F.when(F.col("result") == "win", 0.02).when(F.col("result") == "loss", -0.02).otherwise(0.0)
    form = sum((F.coalesce(F.lag(x, i).over(ordered()), F.lit(0.0)) / i for i in (1, 2, 3)), F.lit(0.0))
    return history(spark, folder).select("id", r6(form).alias("form"))


@query("wn18_recent_five_index_counts_skipped", "WITH " + HISTORY + ", n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC, id DESC) AS n FROM history) SELECT entity, count(*) FILTER (result <> 'draw') AS n, round(avg(value) FILTER (result <> 'draw'), 4) AS mean FROM n WHERE n <= 5 GROUP BY 1")
def wn18(spark, folder):
    five = keyed.first_per_key(history(spark, folder), ["entity"], [F.desc("d"), F.desc("id")], 5)
    real = F.col("result") != "draw"
    return five.groupBy("entity").agg(F.count_if(real).alias("n"), F.round(F.avg(F.when(real, F.col("value"))), 4).alias("mean"))


@query("wn19_last_ten", "WITH " + HISTORY + " SELECT entity, id FROM history QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d DESC, id DESC) <= 10")
def wn19(spark, folder):
    return keyed.first_per_key(history(spark, folder), ["entity"], [F.desc("d"), F.desc("id")], 10).select("entity", "id")


@query("wn20_momentum", "WITH " + HISTORY + """, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC, id DESC) AS n, first_value(result) OVER (PARTITION BY entity ORDER BY d DESC, id DESC) AS f FROM history),
r AS (SELECT entity, f, coalesce(min(n) FILTER (result <> f), max(n) + 1) - 1 AS k FROM n WHERE n <= 10 GROUP BY 1, 2)
SELECT entity, round(CASE f WHEN 'win' THEN least(k / 5.0::DOUBLE, 1) WHEN 'loss' THEN greatest(-k / 3.0::DOUBLE, -1) ELSE 0 END, 6) AS momentum FROM r""")
def wn20(spark, folder):
    """The run at the end of a history: wins by five up to 1, losses by three down to -1."""
    w = Window.partitionBy("entity").orderBy(F.desc("d"), F.desc("id"))
    ten = history(spark, folder).withColumn("n", F.row_number().over(w)).withColumn("f", F.first("result").over(w)).filter("n <= 10")
    run = ten.groupBy("entity").agg(F.first("f").alias("f"), F.min(F.when(F.col("result") != F.col("f"), F.col("n"))).alias("b"), F.max("n").alias("m"))
    k = F.coalesce("b", F.col("m") + 1) - 1
    score = F.when(F.col("f") == "win", F.least(k / 5.0, F.lit(1.0))).when(F.col("f") == "loss", F.greatest(-k / 3.0, F.lit(-1.0))).otherwise(0.0)
    return run.select("entity", r6(score).alias("momentum"))


@query("wn21_upset_rates", "WITH " + HISTORY + """, n AS (SELECT *, (id % 10) / 10.0::DOUBLE AS p, row_number() OVER (PARTITION BY entity ORDER BY d DESC, id DESC) AS n FROM history)
SELECT entity, round(coalesce(avg((result = 'loss')::INT) FILTER (p > 0.55), 0), 6) AS upset, round(coalesce(avg((result = 'win')::INT) FILTER (p < 0.45), 0), 6) AS underdog FROM n WHERE n <= 10 GROUP BY 1""")
def wn21(spark, folder):
    ten = keyed.first_per_key(history(spark, folder), ["entity"], [F.desc("d"), F.desc("id")], 10)
    p = (F.col("id") % 10) / 10.0
    rate = lambda result, given: F.coalesce(F.avg(F.when(given, (F.col("result") == result).cast("int"))), F.lit(0.0))
    return ten.groupBy("entity").agg(r6(rate("loss", p > 0.55)).alias("upset"), r6(rate("win", p < 0.45)).alias("underdog"))


@query("wn22_volatility", "WITH " + HISTORY + " SELECT entity, round(CASE WHEN count(*) < 2 THEN 0.3 ELSE least(stddev_pop(value) / 100000, 1) END, 6) AS volatility FROM history GROUP BY 1")
def wn22(spark, folder):
    score = F.when(F.count("*") < 2, 0.3).otherwise(F.least(F.stddev_pop("value") / 100000, F.lit(1.0)))
    return history(spark, folder).groupBy("entity").agg(r6(score).alias("volatility"))


@query("wn23_leading_wins", "WITH " + HISTORY + ", n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC, id DESC) AS n FROM history) SELECT entity, coalesce(min(n) FILTER (result <> 'win' AND n <= 3), least(3, max(n)) + 1) - 1 AS leading, count(*) FILTER (result = 'win' AND method = 'KO') AS ko5, count(*) FILTER (result = 'win' AND method = 'SUB') AS sub5 FROM n WHERE n <= 5 GROUP BY 1")
def wn23(spark, folder):
    n = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("d"), F.desc("id"))).cast("long")
    five = history(spark, folder).withColumn("n", n).filter("n <= 5")
    win = F.col("result") == "win"
    first_break = F.min(F.when(~win & (F.col("n") <= 3), F.col("n")))
    return five.groupBy("entity").agg((F.coalesce(first_break, F.least(F.lit(3), F.max("n")) + 1) - 1).alias("leading"), F.count_if(win & (F.col("method") == "KO")).alias("ko5"), F.count_if(win & (F.col("method") == "SUB")).alias("sub5"))


@query("wn24_wn25_rank_percentile", "SELECT s_suppkey, rank() OVER (ORDER BY x DESC NULLS LAST)::INT AS rank, round(100 * (1 - rank() OVER (ORDER BY x DESC NULLS LAST) / count(*) OVER ()), 6) AS percentile FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal, -2) END AS x FROM supplier)")
def wn24(spark, folder):
    x = F.when(F.col("s_acctbal") > 0, F.round("s_acctbal", -2))
    rows = table(spark, folder, "supplier").select("s_suppkey", x.alias("x"))
    total = rows.agg(F.count("*").alias("total"))
    placed = ranks.ranked(rows, "x").join(F.broadcast(total), F.lit(True))
    return placed.select("s_suppkey", "rank", r6(100 * (1 - F.col("rank") / F.col("total"))).alias("percentile"))


@query("wn26_first_per_key", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def wn26(spark, folder):
    return keyed.first_per_key(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("wn27_keep_last", "SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def wn27(spark, folder):
    return keyed.first_per_key(table(spark, folder, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("wn28_duplicate_groups", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, o_orderdate) FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)")
def wn28(spark, folder):
    return keyed.duplicates(table(spark, folder, "orders"), ["o_custkey", "o_orderdate"]).select("o_orderkey")


@query("wn29_blocks_of_fifty", "WITH " + HISTORY + ", n AS (SELECT *, (row_number() OVER (PARTITION BY method ORDER BY d, id) - 1) // 50 AS block FROM history) SELECT method, block, count(*) AS n, round(avg((result = 'win')::INT), 6) AS rate FROM n GROUP BY 1, 2")
def wn29(spark, folder):
    block = F.floor((F.row_number().over(Window.partitionBy("method").orderBy("d", "id")) - 1) / 50).cast("long")
    return history(spark, folder).withColumn("block", block).groupBy("method", "block").agg(F.count("*").alias("n"), r6(F.avg((F.col("result") == "win").cast("int"))).alias("rate"))


@query("wn30_last_hundred", "WITH " + HISTORY + " SELECT id FROM history ORDER BY d DESC, id DESC LIMIT 100")
def wn30(spark, folder):
    """The last hundred rows: the limit is the feature."""
    return history(spark, folder).orderBy(F.desc("d"), F.desc("id")).limit(100).select("id")


@query("wn31_last_days", "WITH " + HISTORY + " SELECT id FROM history WHERE d::DATE IN (SELECT DISTINCT d::DATE FROM history ORDER BY 1 DESC LIMIT 5)")
def wn31(spark, folder):
    days = history(spark, folder).select(F.to_date("d").alias("day")).distinct().orderBy(F.desc("day")).limit(5)
    return history(spark, folder).withColumn("day", F.to_date("d")).join(days, "day", "left_semi").select("id")


@query("wn32_first_of_pair", "WITH " + CONTEST + " SELECT id FROM contest QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b), d::DATE ORDER BY d, id) = 1")
def wn32(spark, folder):
    return first_of_pair(contests(spark, folder)).select("id")


@query("wn33_seen_before", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, ts::DATE")
def wn33(spark, folder):
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("event_id")).select("event_id")
