"""Projections, filters and predicates as queries (PRJ)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ringledger.operators import metrics, rules
from ringledger.operators.contests import canonical
from ringledger.plans.base import CONTEST, HISTORY, PREDICTION, Module, contests, history, predictions
from ringledger.sources.tables import table

M = Module()
query = M.query


@query("prj1_projection_across_joins", "SELECT o_orderkey, c_name AS buyer, n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def prj1(spark, folder):
    o, c, n, r = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", F.col("c_name").alias("buyer"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("prj2_half_open_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'")
def prj2(spark, folder):
    return table(spark, folder, "orders").filter("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1996-01-01'").select("o_orderkey")


@query("prj4_year_as_range", "SELECT count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997")
def prj4(spark, folder):
    """A year filter written as a range, so that it reaches the scan."""
    return table(spark, folder, "orders").filter("o_orderdate >= timestamp_ntz '1997-01-01'").agg(F.count("*").alias("n"))


@query("prj5_not_null", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) WHERE s IS NOT NULL AND b IS NOT NULL")
def prj5(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("s"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b"))
    return c.dropna(subset=["s", "b"]).select("c_custkey")


@query("prj6_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def prj6(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("prj7_all_keywords", "SELECT p_partkey FROM part WHERE p_type ILIKE '%e%' AND p_type ILIKE '%A%'")
def prj7(spark, folder):
    conditions = [F.col("p_type").ilike(f"%{w}%") for w in ("e", "A")]
    return table(spark, folder, "part").filter(reduce(lambda x, y: x & y, conditions)).select("p_partkey")


@query("prj8_equal_then_like", "SELECT c_custkey, arg_min(n_nationkey, tier) AS n_nationkey FROM (SELECT c_custkey, n_nationkey, CASE WHEN c_nationkey = n_nationkey THEN 1 ELSE 2 END AS tier FROM customer JOIN nation ON c_nationkey = n_nationkey OR c_nationkey % 5 = n_nationkey) GROUP BY 1")
def prj8(spark, folder):
    """An exact tier and a looser one, the better hit wins: two equi-joins, not one join on an OR."""
    c, n = table(spark, folder, "customer").select("c_custkey", "c_nationkey"), table(spark, folder, "nation").select("n_nationkey")
    first = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_nationkey", F.lit(1).alias("tier"))
    second = c.join(n, c.c_nationkey % 5 == n.n_nationkey).select("c_custkey", "n_nationkey", F.lit(2).alias("tier"))
    return first.unionByName(second).groupBy("c_custkey").agg(F.min_by("n_nationkey", "tier").alias("n_nationkey"))


@query("prj9_optional_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def prj9(spark, folder):
    rows, wanted = table(spark, folder, "orders"), {"o_orderstatus": "O", "o_orderpriority": None}
    for column, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.select("o_orderkey")


@query("prj10_symmetric_pair", "WITH " + CONTEST + " SELECT count(*) AS n, count(DISTINCT (least(a, b), greatest(a, b))) AS pairs FROM contest")
def prj10(spark, folder):
    lo, hi = canonical("a", "b")
    return contests(spark, folder).select(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"), F.countDistinct(F.struct("lo", "hi")).alias("pairs"))


@query("prj11_row_order_predicate", "WITH " + HISTORY + " SELECT entity, id FROM history h WHERE (d, id) < (SELECT (max(d), 0::BIGINT) FROM history) AND (d < TIMESTAMP '1995-03-01' OR (d = TIMESTAMP '1995-03-01' AND id < 1000))")
def prj11(spark, folder):
    h = history(spark, folder)
    return h.filter(F.struct("d", "id") < F.struct(F.expr("timestamp_ntz '1995-03-01'").alias("d"), F.lit(1000).cast("long").alias("id"))).select("entity", "id")


@query("prj12_flags", "SELECT o_orderkey, o_totalprice > 200000 AND o_orderstatus = 'F' AS big_won, NOT (o_totalprice > 200000) OR o_orderstatus = 'O' AS other FROM orders")
def prj12(spark, folder):
    big, done = F.col("o_totalprice") > 200000, F.col("o_orderstatus")
    return table(spark, folder, "orders").select("o_orderkey", (big & (done == "F")).alias("big_won"), (~big | (done == "O")).alias("other"))


@query("prj13_favourite_won", "WITH " + CONTEST + " SELECT id, (x > y AND winner = a) OR (x < y AND winner = b) AS favourite_won FROM (SELECT c.*, s.s_acctbal AS x, t.s_acctbal AS y FROM contest c JOIN supplier s ON a = s.s_suppkey JOIN supplier t ON b = t.s_suppkey)")
def prj13(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    c = contests(spark, folder).join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b")
    won = F.col("winner") == F.col("a")
    return c.select("id", (((F.col("x") > F.col("y")) & won) | ((F.col("x") < F.col("y")) & ~won)).alias("favourite_won"))


@query("prj14_case_buckets", "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'large' END AS size, count(*) AS n FROM orders GROUP BY 1")
def prj14(spark, folder):
    size = F.when(F.col("o_totalprice") < 50000, "small").when(F.col("o_totalprice") < 200000, "middle").otherwise("large")
    return table(spark, folder, "orders").groupBy(size.alias("size")).agg(F.count("*").alias("n"))


@query("prj15_bins_open_both_ways", """SELECT b.lo, count(*) FILTER (x > b.lo AND x <= b.hi) AS upper_closed, count(*) FILTER (x >= b.lo AND x < b.hi) AS lower_closed
FROM (SELECT l_discount * 100 AS x FROM lineitem), (VALUES (0, 3), (3, 6), (6, 11)) b(lo, hi) GROUP BY 1""")
def prj15(spark, folder):
    x = F.col("l_discount") * 100
    bins = F.filter(F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((0, 3), (3, 6), (6, 11)))), lambda e: (x >= e["lo"]) & (x <= e["hi"]))
    each = table(spark, folder, "lineitem").select(x.alias("x"), F.explode(bins).alias("e"))
    return each.groupBy(F.col("e.lo").alias("lo")).agg(F.count_if((F.col("x") > F.col("e.lo")) & (F.col("x") <= F.col("e.hi"))).alias("upper_closed"), F.count_if((F.col("x") >= F.col("e.lo")) & (F.col("x") < F.col("e.hi"))).alias("lower_closed"))


@query("prj16_rating_tiers", "SELECT CASE WHEN x >= 1650 THEN 'elite' WHEN x >= 1550 THEN 'good' WHEN x >= 1450 THEN 'average' ELSE 'low' END AS tier, count(*) AS n FROM (SELECT 1500 + s_acctbal / 20 AS x FROM supplier) GROUP BY 1")
def prj16(spark, folder):
    x = 1500 + F.col("s_acctbal") / 20
    tier = F.when(x >= 1650, "elite").when(x >= 1550, "good").when(x >= 1450, "average").otherwise("low")
    return table(spark, folder, "supplier").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("prj17_confidence_tiers", "WITH " + PREDICTION + " SELECT CASE WHEN p >= 0.70 THEN 'high' WHEN p >= 0.60 THEN 'medium' WHEN p >= 0.55 THEN 'low' ELSE 'toss-up' END AS tier, count(*) AS n FROM prediction GROUP BY 1")
def prj17(spark, folder):
    return predictions(spark, folder).groupBy(metrics.tier(F.col("p")).alias("tier")).agg(F.count("*").alias("n"))


@query("prj19_five_percent_bands", "WITH " + PREDICTION + " SELECT greatest(0.5, least(0.95, round_even(p * 20, 0) / 20))::DOUBLE AS band, count(*) AS n FROM prediction GROUP BY 1")
def prj19(spark, folder):
    return predictions(spark, folder).groupBy(metrics.band(F.col("p")).alias("band")).agg(F.count("*").alias("n"))


@query("prj20_active", "SELECT o_custkey, max(o_orderdate) AS last, date_diff('day', max(o_orderdate)::DATE, DATE '1998-08-02') <= 730 AS active FROM orders GROUP BY 1")
def prj20(spark, folder):
    last = F.max("o_orderdate")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(last.alias("last"), (F.datediff(F.lit("1998-08-02").cast("date"), last) <= 730).alias("active"))


@query("prj22_required_fields", "SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS rejected FROM (SELECT coalesce(trim(s) <> '', false) AS ok FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END AS s FROM customer))")
def prj22(spark, folder):
    k = F.col("c_custkey") % 3
    rows = table(spark, folder, "customer").select(F.when(k == 0, None).when(k == 1, " ").otherwise(F.col("c_name")).alias("s"))
    good, bad = rules.valid_and_rejected(rows, ["s"])
    counted = good.select(F.lit(1).alias("ok")).unionByName(bad.select(F.lit(0).alias("ok")))
    return counted.agg(F.count_if(F.col("ok") == 1).alias("valid"), F.count_if(F.col("ok") == 0).alias("rejected"))



def customer_rules():
    return {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "MACHINERY", "nation": F.col("c_nationkey").between(0, 20)}


@query("prj23_warnings", "SELECT c_custkey, 'balance' AS rule FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT c_custkey, 'nation' FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 20")
def prj23(spark, folder):
    return rules.warnings_of(table(spark, folder, "customer"), customer_rules(), ["c_custkey"])


@query("prj24_violations", "SELECT 'balance' AS rule, count(*) AS n FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT 'segment', count(*) FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL SELECT 'nation', count(*) FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 20")
def prj24(spark, folder):
    return rules.violations(table(spark, folder, "customer"), customer_rules())


@query("prj25_coerce", "SELECT sum(TRY_CAST(right(c_name, 4) AS INTEGER))::BIGINT AS total, count(*) FILTER (TRY_CAST(left(c_name, 4) AS INTEGER) IS NULL) AS bad FROM customer")
def prj25(spark, folder):
    return table(spark, folder, "customer").agg(F.sum(F.right("c_name", F.lit(4)).try_cast("int")).alias("total"), F.count_if(F.left("c_name", F.lit(4)).try_cast("int").isNull()).alias("bad"))


@query("prj26_url_pattern", "SELECT regexp_matches(url, '^https?://') AS web, count(*) AS n FROM pages GROUP BY 1")
def prj26(spark, folder):
    return table(spark, folder, "pages").groupBy(F.col("url").rlike("^https?://").alias("web")).agg(F.count("*").alias("n"))


@query("prj27_alternation_null_is_false", "SELECT count(*) FILTER (coalesce(regexp_matches(x, '(?i)steel|tin'), false)) AS hits, count(*) AS n FROM (SELECT nullif(p_type, 'x') AS x FROM part)")
def prj27(spark, folder):
    hit = F.coalesce(F.nullif(F.col("p_type"), F.lit("x")).rlike("(?i)steel|tin"), F.lit(False))
    return table(spark, folder, "part").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


@query("prj28_few_nulls_gate", "SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END) + (CASE WHEN c_nationkey > 5 THEN 0 ELSE 1 END) <= 1")
def prj28(spark, folder):
    cells = F.array(F.when(F.col("c_acctbal") > 0, 1), F.when(F.col("c_mktsegment") == "BUILDING", 1), F.when(F.col("c_nationkey") > 5, 1))
    return table(spark, folder, "customer").filter(F.size(F.filter(cells, lambda x: x.isNull())) <= 1).select("c_custkey")


@query("prj29_derived_kind", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'title' WHEN o_totalprice > 250000 THEN 'main' ELSE 'regular' END AS kind FROM orders")
def prj29(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "title").when(F.col("o_totalprice") > 250000, "main").otherwise("regular").alias("kind"))


@query("prj30_flipped_result", "WITH " + HISTORY + " SELECT id, CASE result WHEN 'win' THEN 'loss' WHEN 'loss' THEN 'win' ELSE result END AS other FROM history")
def prj30(spark, folder):
    r = F.col("result")
    return history(spark, folder).select("id", F.when(r == "win", "loss").when(r == "loss", "win").otherwise(r).alias("other"))


@query("prj31_winner_from_result", "WITH " + HISTORY + " SELECT id, CASE result WHEN 'win' THEN entity WHEN 'loss' THEN entity + 1 END AS winner, CASE result WHEN 'win' THEN entity + 1 WHEN 'loss' THEN entity END AS loser FROM history")
def prj31(spark, folder):
    r, e = F.col("result"), F.col("entity")
    return history(spark, folder).select("id", F.when(r == "win", e).when(r == "loss", e + 1).alias("winner"), F.when(r == "win", e + 1).when(r == "loss", e).alias("loser"))
