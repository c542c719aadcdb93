"""Joins, lookups and subqueries as queries (JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringledger.operators import asof, fuzzy, keyed, rules
from ringledger.operators.contests import long_form
from ringledger.plans.base import CONTEST, HISTORY, LONG, Module, contests, history
from ringledger.sources.tables import table

M = Module()
query = M.query


def supplier_roles(spark, folder):
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))


@query("jn1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn1(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("jn2_left_enrichment", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def jn2(spark, folder):
    """Counted before the join: the large side is reduced by key first."""
    n = table(spark, folder, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, folder, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])


@query("jn3_two_roles", "WITH " + CONTEST + " SELECT id, s.s_name AS name_a, t.s_name AS name_b FROM contest JOIN supplier s ON a = s.s_suppkey JOIN supplier t ON b = t.s_suppkey")
def jn3(spark, folder):
    s = supplier_roles(spark, folder).select("k", "name")
    return contests(spark, folder).join(s.toDF("a", "name_a"), "a").join(s.toDF("b", "name_b"), "b").select("id", "name_a", "name_b")


@query("jn4_star_both_sides", "WITH " + CONTEST + """ SELECT id, x.s_acctbal AS balance_a, y.s_acctbal AS balance_b, m.n_name AS nation_a, n.n_name AS nation_b, p.r_name AS region_a, q.r_name AS region_b FROM contest
LEFT JOIN supplier x ON a = x.s_suppkey LEFT JOIN supplier y ON b = y.s_suppkey LEFT JOIN nation m ON x.s_nationkey = m.n_nationkey LEFT JOIN nation n ON y.s_nationkey = n.n_nationkey
LEFT JOIN region p ON m.n_regionkey = p.r_regionkey LEFT JOIN region q ON n.n_regionkey = q.r_regionkey""")
def jn4(spark, folder):
    """One dimension is assembled once and joined in two roles."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("n_nationkey").alias("nation"), "n_name", "r_name")
    side = supplier_roles(spark, folder).join(place, "nation", "left").select("k", "balance", "n_name", "r_name")
    out = contests(spark, folder)
    for x in ("a", "b"):
        out = out.join(side.toDF(x, f"balance_{x}", f"nation_{x}", f"region_{x}"), x, "left")
    return out.select("id", *(f"{c}_{x}" for c in ("balance", "nation", "region") for x in ("a", "b")))


@query("jn10_composite_key", "SELECT count(*) AS n FROM orders o JOIN (SELECT DISTINCT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F') x ON o.o_custkey = x.o_custkey AND o.o_orderdate = x.o_orderdate")
def jn10(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    right = o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderdate").distinct()
    return o.join(right, ["o_custkey", "o_orderdate"]).agg(F.count("*").alias("n"))


@query("jn12_expression_key", "WITH " + CONTEST + " SELECT id, n_name FROM contest JOIN supplier ON s_suppkey = CASE WHEN winner = a THEN b ELSE a END JOIN nation ON s_nationkey = n_nationkey")
def jn12(spark, folder):
    loser = contests(spark, folder).select("id", F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("k"))
    n = table(spark, folder, "nation")
    return loser.join(supplier_roles(spark, folder), "k").join(n, F.col("nation") == n.n_nationkey).select("id", "n_name")


@query("jn13_asof_inclusive", "SELECT e.event_id, m.event_id AS asof_m FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') m ON e.user_id = m.user_id AND e.ts >= m.ts")
def jn13(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("m"))
    return asof.asof(e.select("event_id", "user_id", "ts"), right, "user_id", "ts", ["m"], "m", strict=False).select("event_id", "asof_m")


@query("jn14_asof_strict", "WITH " + HISTORY + " SELECT l.id, max(r.id) AS asof_id, count(*) AS n FROM history l JOIN (SELECT entity, d, max(id) AS id FROM history GROUP BY 1, 2) r ON l.entity = r.entity AND r.d = (SELECT max(d) FROM history x WHERE x.entity = l.entity AND x.d < l.d) GROUP BY 1")
def jn14(spark, folder):
    h = history(spark, folder).select("entity", "d", "id")
    found = asof.asof(h, h, "entity", "d", ["id"], "id", strict=True)
    return found.filter("asof_id is not null").select("id", "asof_id", F.lit(1).cast("long").alias("n"))


@query("jn15_point_lookup", "SELECT event_id, o_totalprice FROM events LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON user_id = o_custkey")
def jn15(spark, folder):
    """A lookup for each row as one join with a right side that has one row a key."""
    one = asof.latest(table(spark, folder, "orders"), "o_custkey", ["o_orderkey"], ["o_totalprice"])
    e = table(spark, folder, "events").select("event_id", "user_id")
    return e.join(one, e.user_id == one.o_custkey, "left").select("event_id", "o_totalprice")


@query("jn16_two_tiers", "SELECT s_suppkey, coalesce(c.c_acctbal, n.b, 1500.0::DOUBLE) AS rating FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON s_suppkey = c_custkey LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS b FROM customer WHERE c_nationkey < 10 GROUP BY 1) n ON s_nationkey = n.c_nationkey")
def jn16(spark, folder):
    c = table(spark, folder, "customer")
    by_key = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("x"))
    by_nation = c.filter("c_nationkey < 10").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_acctbal").alias("y"))
    return table(spark, folder, "supplier").join(by_key, "s_suppkey", "left").join(by_nation, "s_nationkey", "left").select("s_suppkey", F.coalesce("x", "y", F.lit(1500.0)).alias("rating"))


@query("jn17_lateral_top1", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true")
def jn17(spark, folder):
    last = asof.latest(table(spark, folder, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    c = table(spark, folder, "customer").select("c_custkey")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("jn18_correlated_scalar", "SELECT c_custkey, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 1500.0::DOUBLE) AS rating FROM customer")
def jn18(spark, folder):
    best = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return table(spark, folder, "customer").join(best, "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(1500.0)).alias("rating"))


@query("jn19_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders)")
def jn19(spark, folder):
    return spark.sql("SELECT o_orderkey FROM {o} WHERE o_orderdate = (SELECT min(o_orderdate) FROM {o})", o=table(spark, folder, "orders"))


@query("jn20_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn20(spark, folder):
    big = table(spark, folder, "orders").filter("o_totalprice > 300000")
    c = table(spark, folder, "customer")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").select("c_custkey")


@query("jn22_join_of_results", "WITH x AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT user_id AS k, count(*) AS m FROM events GROUP BY 1) SELECT x.k, n, m FROM x JOIN y ON x.k = y.k")
def jn22(spark, folder):
    x = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    y = table(spark, folder, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("m"))
    return x.join(y, "k")


@query("jn23_lookup_with_default", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(s_acctbal, 1500) AS rating FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def jn23(spark, folder):
    s = table(spark, folder, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.join(s, line.l_suppkey == s.s_suppkey, "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("s_acctbal", F.lit(1500.0)).alias("rating"))


@query("jn24_semi_by_ids", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn24(spark, folder):
    ids = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("jn25_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def jn25(spark, folder):
    return rules.orphans(table(spark, folder, "orders"), table(spark, folder, "customer").filter("c_nationkey <> 3"), "o_custkey", "c_custkey").select("o_orderkey")


@query("jn26_pairs_in_group", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
def jn26(spark, folder):
    """The feature itself is all unordered pairs of a group (a nation's suppliers)."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return s.toDF("a", "g").join(s.toDF("b", "g"), "g").filter("a < b").select("a", "b")


@query("jn27_blocked_fuzzy_match", "SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND levenshtein(right(c_name, 4), right(s_name, 4)) <= 1 GROUP BY 1")
def jn27(spark, folder):
    """By the index of deletion keys within a nation; the suppliers of a name are one row before they are joined."""
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.right("c_name", F.lit(4)).alias("name"))
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), F.right("s_name", F.lit(4)).alias("name"))
    near = fuzzy.within(c, s, 1, block=["g"])
    first = s.groupBy(F.col("g").alias("_g"), F.col("name").alias("_n")).agg(F.min("s_suppkey").alias("s_suppkey"))
    best = near.join(first, (F.col("g") == F.col("_g")) & (F.col("right_name") == F.col("_n"))).groupBy(F.col("g").alias("_h"), F.col("left_name")).agg(F.min("s_suppkey").alias("s_suppkey"))
    return c.join(best, (F.col("g") == F.col("_h")) & (F.col("name") == F.col("left_name"))).select("c_custkey", "s_suppkey")


@query("jn28_source_priority_merge", """WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance, s_nationkey AS nation FROM supplier WHERE s_acctbal < 5000),
q AS (SELECT s_suppkey AS k, -1.0::DOUBLE AS balance, CASE WHEN s_nationkey > 5 THEN s_nationkey + 100 END AS nation FROM supplier WHERE s_acctbal >= 0)
SELECT coalesce(p.k, q.k) AS k, coalesce(p.balance, q.balance) AS balance, coalesce(q.nation, p.nation) AS nation, CASE WHEN q.k IS NULL THEN 'primary' WHEN p.k IS NULL THEN 'secondary' ELSE 'both' END AS origin FROM p FULL JOIN q ON p.k = q.k""")
def jn28(spark, folder):
    s = table(spark, folder, "supplier")
    p = s.filter("s_acctbal < 5000").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").alias("nation"))
    q = s.filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("k"), F.lit(-1.0).alias("balance"), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey") + 100).alias("nation"))
    return keyed.merge_sources(p, q, "k", ["balance"], ["nation"])


@query("jn29_substring_dictionary", "SELECT page_id, arg_min(n_nationkey, n_nationkey) AS nation FROM pages JOIN nation ON contains(lower(html), lower(right(n_name, 2))) GROUP BY 1")
def jn29(spark, folder):
    """A dictionary of fixed size (25 nations), first entry wins: an array on the row instead of a join."""
    entries = table(spark, folder, "nation").select("n_nationkey", F.lower(F.right("n_name", F.lit(2))).alias("w"))
    words = entries.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "w"))).alias("words"))
    hit = F.filter("words", lambda e: F.lower("html").contains(e["w"]))
    found = table(spark, folder, "pages").join(F.broadcast(words), F.lit(True)).select("page_id", hit.alias("hit"))
    return found.filter(F.size("hit") > 0).select("page_id", F.col("hit")[0]["n_nationkey"].alias("nation"))


@query("jn30_membership_default", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE 'Other' END AS zone FROM nation")
def jn30(spark, folder):
    zones = F.create_map(F.lit(0), F.lit("south"), F.lit(1), F.lit("west"))
    return table(spark, folder, "nation").select("n_nationkey", F.coalesce(F.try_element_at(zones, F.col("n_regionkey")), F.lit("Other")).alias("zone"))


@query("jn5_long_form_rating_join", "WITH " + LONG + " SELECT n_name, count(*) AS n, sum(won::INT)::BIGINT AS wins, round(avg(s_acctbal), 4) AS balance FROM side JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def jn5(spark, folder):
    """Both roles at once on the long form: one join instead of two."""
    n = table(spark, folder, "nation")
    side = long_form(contests(spark, folder)).join(supplier_roles(spark, folder), F.col("entity") == F.col("k")).join(n, F.col("nation") == n.n_nationkey)
    return side.groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.col("won").cast("int")).alias("wins"), F.round(F.avg("balance"), 4).alias("balance"))


@query("jn11_entity_contest_key", "WITH " + LONG + " SELECT x.id, x.entity, y.won AS opponent_won FROM side x JOIN side y ON x.id = y.id AND x.opponent = y.entity")
def jn11(spark, folder):
    side = long_form(contests(spark, folder))
    other = side.select("id", F.col("entity").alias("opponent"), F.col("won").alias("opponent_won"))
    return side.join(other, ["id", "opponent"]).select("id", "entity", "opponent_won")


