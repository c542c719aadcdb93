"""Queries of tables that change: schemas applied, rebuilt and emptied, upserts resolved by other keys, recomputed columns, reports, staleness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringledger.functions import ratings as R
from ringledger.functions import text as T
from ringledger.operators import keyed, rules
from ringledger.plans.base import CONTEST, HISTORY, PREDICTION, Module, contests, history, predictions, r6
from ringledger.sources import files, managed
from ringledger.sources.tables import table

M = Module()
query = M.query


@query("src4_json_cache", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src4(spark, folder):
    """A cache of JSON lines, written and read with a declared schema."""
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return files.read_json(spark, files.write_json(rows), rows.schema)


@query("src8_full_table", "SELECT * FROM nation")
def src8(spark, folder):
    return table(spark, folder, "nation")


@query("src12_paginated_list", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5)::INT AS page FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 500 * 5")
def src12(spark, folder):
    """Lists in pages of five, at most 500 pages of each list (the cap is the feature)."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, folder, "orders").select("o_orderkey", F.floor(n / 5).cast("int").alias("page")).filter("page < 500")


@query("src17_result_of_page", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p\\b')) AS paragraphs FROM pages")
def src17(spark, folder):
    """Fields of a result page by patterns."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, folder, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit(r"<p\b")).cast("long").alias("paragraphs"))


@query("src21_card_to_contests", "WITH l AS (SELECT o_orderkey, 'A' || o_custkey || ' vs. B' || o_orderkey AS line FROM orders) SELECT o_orderkey, split_part(line, ' vs. ', 1) AS a, split_part(line, ' vs. ', 2) AS b FROM l")
def src21(spark, folder):
    """Lines of a card as pairs of sides."""
    line = F.concat(F.lit("A"), F.col("o_custkey"), F.lit(" vs. B"), F.col("o_orderkey"))
    sides = F.split(line, r"\s+vs\.?\s+")
    return table(spark, folder, "orders").select("o_orderkey", sides[0].alias("a"), sides[1].alias("b"))


@query("snk1_csv", "SELECT n_nationkey, n_name FROM nation")
def snk1(spark, folder):
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return files.read_csv(spark, files.write_csv(rows), rows.schema)


@query("snk2_csv_rewritten_after_merge", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def snk2(spark, folder):
    """A keyed CSV file is read, merged with new rows and written anew as a whole."""
    old = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    kept = files.read_csv(spark, files.write_csv(old), old.schema)
    merged = keyed.upsert(kept, old.filter("s_acctbal < 0").withColumn("s_acctbal", F.lit(0.0)), ["s_suppkey"])
    return files.read_csv(spark, files.write_csv(merged), old.schema)


@query("snk4_json_report", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snk4(spark, folder):
    report = table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return files.read_json(spark, files.write_json(report), report.schema)


@query("snk5_text_report", "SELECT 'status ' || o_orderstatus || ': ' || count(*) || ' orders' AS value FROM orders GROUP BY o_orderstatus")
def snk5(spark, folder):
    """A report as lines of text."""
    each = table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return files.read_text(spark, files.write_text(each.select(F.concat(F.lit("status "), "o_orderstatus", F.lit(": "), F.col("n"), F.lit(" orders")).alias("value"))))


@query("snk6_schema_applied", "SELECT * FROM (VALUES ('contest', 0::BIGINT, 5), ('entity', 0, 2)) t(name, n, columns)")
def snk6(spark, folder):
    """All tables of a schema dropped and made anew, empty."""
    made = managed.apply_schema(spark, {"entity": "id long, name string", "contest": "id long, d timestamp, a long, b long, winner long"})
    return managed.report(spark, made)


@query("snk7_truncate_and_rebuild", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def snk7(spark, folder):
    """A derived table is replaced as a whole, twice."""
    each = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    made = managed.apply_schema(spark, {"totals": "o_custkey long, n long"})
    for rows in (each.limit(1), each):
        managed.rebuild(rows, made["totals"])
    return spark.table(made["totals"])


@query("snk8_ordered_delete", "SELECT * FROM (VALUES (1, 'lines', 0::BIGINT), (2, 'orders', 0)) t(step, name, left_over)")
def snk8(spark, folder):
    """Children are emptied before the tables that they point to."""
    made = managed.apply_schema(spark, {"lines": "l_orderkey long, l_linenumber int", "orders": "o_orderkey long"})
    managed.rebuild(table(spark, folder, "orders").select("o_orderkey"), made["orders"])
    managed.rebuild(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), made["lines"])
    return managed.clear(spark, made, managed.children_first({"lines": ["orders"], "orders": []}))


@query("snk11_upsert_by_url", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal < 0 THEN -1.0::DOUBLE END, s_acctbal) AS s_acctbal FROM supplier")
def snk11(spark, folder):
    """New values come with another key (an address), which is resolved first."""
    base = table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("http://x/"), "s_name").alias("url"), "s_acctbal")
    news = base.filter("s_acctbal < 0").select("url", F.lit(-1.0).alias("s_acctbal"))
    resolved = news.join(base.select("url", "s_suppkey"), "url").select("s_suppkey", "s_acctbal")
    return keyed.override(base, resolved, ["s_suppkey"], ["s_acctbal"]).select("s_suppkey", "s_acctbal")


@query("snk15_snk16_bulk_upsert", """WITH n AS (SELECT l_orderkey AS k1, l_suppkey AS k2, max(l_discount) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), o AS (SELECT l_orderkey AS k1, l_suppkey AS k2, max(l_tax) AS x FROM lineitem GROUP BY ALL)
SELECT k1, k2, coalesce(n.x, o.x) AS x FROM o LEFT JOIN n USING (k1, k2)""")
def snk15(spark, folder):
    """Insert or update by two keys, in bulk."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_suppkey").alias("k2"), "l_discount", "l_tax", "l_returnflag")
    old, new = rows.groupBy("k1", "k2").agg(F.max("l_tax").alias("x")), rows.filter("l_returnflag = 'R'").groupBy("k1", "k2").agg(F.max("l_discount").alias("x"))
    return keyed.upsert(old, new, ["k1", "k2"])


@query("snk17_ids_from_urls", "SELECT page_id, url, dense_rank() OVER (ORDER BY url) > 0 AS known FROM pages")
def snk17(spark, folder):
    """Rows find their ids by address: a join instead of a map in memory."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    ids = pages.groupBy("url").agg(F.min("page_id").alias("id"))
    return pages.join(ids, "url").select("page_id", "url", F.col("id").isNotNull().alias("known"))


@query("snk19_save_prediction", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN nullif(o_orderpriority, '') END, o_orderstatus) AS note FROM orders")
def snk19(spark, folder):
    """A saved prediction takes new values unless they are blank."""
    base = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("note"))
    news = table(spark, folder, "orders").select("o_orderkey", F.nullif(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(""), F.lit("")).alias("note"))
    return keyed.override(base, news, ["o_orderkey"], ["note"])


@query("snk22_recomputed_from_base", "SELECT c_custkey, round(1500 + c_acctbal / 20 - (c_nationkey + 5), 6) AS adjusted FROM customer")
def snk22(spark, folder):
    """Penalties are updated in bulk, the adjusted column is derived from its base columns."""
    base = table(spark, folder, "customer").select("c_custkey", (1500 + F.col("c_acctbal") / 20).alias("rating"), F.lit(0).alias("penalty"))
    news = table(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") + 5).alias("penalty"))
    return keyed.override(base, news, ["c_custkey"], ["penalty"]).select("c_custkey", r6(F.col("rating") - F.col("penalty")).alias("adjusted"))


@query("snk23_injury_log", "SELECT s_suppkey, count(*) AS checks, max(event_id) AS last_check FROM supplier JOIN events ON user_id = s_suppkey WHERE event_type = 'error' GROUP BY 1")
def snk23(spark, folder):
    """A log of checks is appended to; the profile keeps their number and the last one."""
    log = table(spark, folder, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("s_suppkey")).agg(F.count("*").alias("checks"), F.max("event_id").alias("last_check"))
    return table(spark, folder, "supplier").select("s_suppkey").join(log, "s_suppkey")


@query("snk25_migration", "SELECT n_nationkey, n_name, NULL::VARCHAR AS style, 'unknown' AS origin FROM nation")
def snk25(spark, folder):
    """A migration adds columns, one of them with a default; run twice, it changes nothing more."""
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        rows = managed.migrate(rows, {"style": ("string", None), "origin": ("string", "unknown")})
    return rows


@query("snk26_styles_written", "SELECT s_suppkey, CASE WHEN (s_suppkey % 35) / 10.0::DOUBLE > 2.5 THEN 'wrestler' WHEN (s_suppkey % 15) / 10.0::DOUBLE > 1 THEN 'grappler' WHEN (s_suppkey % 60) / 10.0::DOUBLE > 4 AND (s_suppkey % 35) / 10.0::DOUBLE < 2 THEN 'striker' ELSE 'balanced' END AS style FROM supplier")
def snk26(spark, folder):
    k = F.col("s_suppkey")
    base = table(spark, folder, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("style"))
    styles = base.select("s_suppkey", R.style(k % 60 / 10.0, k % 35 / 10.0, k % 15 / 10.0).alias("style"))
    return keyed.override(base, styles, ["s_suppkey"], ["style"])


@query("prj3_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1999-06-01'")
def prj3(spark, folder):
    return table(spark, folder, "orders").filter("o_orderdate >= timestamp_ntz '1999-06-01'").select("o_orderkey")


@query("prj18_bucket_labels", "WITH " + PREDICTION + " SELECT id, CASE WHEN p < 0.55 THEN '50-55%' WHEN p < 0.60 THEN '55-60%' WHEN p < 0.65 THEN '60-65%' WHEN p < 0.70 THEN '65-70%' ELSE '70%+' END AS label FROM prediction")
def prj18(spark, folder):
    p = F.col("p")
    return predictions(spark, folder).select("id", F.when(p < 0.55, "50-55%").when(p < 0.60, "55-60%").when(p < 0.65, "60-65%").when(p < 0.70, "65-70%").otherwise("70%+").alias("label"))


@query("prj21_active_counted_not_dropped", "SELECT c_custkey, c_acctbal > 0 AS active FROM customer")
def prj21(spark, folder):
    """The activity filter marks; it drops nothing."""
    return table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("active"))


@query("prj32_winner_and_loser", "WITH " + HISTORY + " SELECT id, CASE WHEN result = 'loss' THEN id ELSE entity END AS winner, CASE WHEN result = 'loss' THEN entity ELSE id END AS loser, result = 'draw' AS drawn FROM history")
def prj32(spark, folder):
    """Who won and who lost by a row's result; a draw keeps the order, an unknown result is left out."""
    lost = F.col("result") == "loss"
    rows = history(spark, folder).filter(F.col("result").isin("win", "loss", "draw"))
    return rows.select("id", F.when(lost, F.col("id")).otherwise(F.col("entity")).alias("winner"), F.when(lost, F.col("entity")).otherwise(F.col("id")).alias("loser"), (F.col("result") == "draw").alias("drawn"))


@query("jn21_derived_then_ordered", "SELECT * FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) WHERE total > 1000000 ORDER BY total DESC, o_custkey")
def jn21(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).filter("total > 1000000").orderBy(F.desc("total"), "o_custkey")


@query("ag10_average_of_joined", "SELECT round(avg(s_acctbal), 4) AS a, round(avg(l_quantity), 4) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def ag10(spark, folder):
    line, s = table(spark, folder, "lineitem").select("l_suppkey", "l_quantity"), table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return line.join(s, "l_suppkey").agg(F.round(F.avg("s_acctbal"), 4).alias("a"), F.round(F.avg("l_quantity"), 4).alias("b"))


@query("ag14_events_of_days", "SELECT event_type, ts::DATE AS day, count(*) AS n FROM events WHERE value > 10 GROUP BY 1, 2 ORDER BY n DESC, event_type, day LIMIT 10")
def ag14(spark, folder):
    """The ten largest groups: the limit is the feature."""
    each = table(spark, folder, "events").filter("value > 10").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "event_type", "day").limit(10)


@query("ag18_least_samples", "SELECT * FROM (VALUES (10), (20), (30)) v(least), LATERAL (SELECT count(*) AS groups FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= v.least))")
def ag18(spark, folder):
    """How many groups reach each minimum, in one pass."""
    each = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    counted = each.agg(*(F.count_if(F.col("n") >= x).alias(str(x)) for x in (10, 20, 30)))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(x).alias("least"), F.col(str(x)).alias("groups")) for x in (10, 20, 30)))).alias("r")).select("r.*")


@query("ag32_ag33_sums_by_bin", "WITH " + PREDICTION + " SELECT floor(p * 20)::INT AS bin, round(sum(p), 4) AS predicted, count(*) FILTER (won) AS actual, count(*) AS n FROM prediction GROUP BY 1")
def ag32(spark, folder):
    each = predictions(spark, folder).groupBy(F.floor(F.col("p") * 20).cast("int").alias("bin"))
    return each.agg(F.round(F.sum("p"), 4).alias("predicted"), F.count_if("won").alias("actual"), F.count("*").alias("n"))


@query("ag40_last_date_of_key", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1")
def ag40(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last"))


@query("wn16_other_side_counts_time_only", "WITH " + CONTEST + ", s AS (SELECT a AS entity, id % 7 AS strikes, 5 + id % 10 AS minutes FROM contest UNION ALL SELECT b, 0, 5 + id % 10 FROM contest) SELECT entity, sum(strikes)::BIGINT AS strikes, sum(minutes)::BIGINT AS minutes FROM s GROUP BY 1")
def wn16(spark, folder):
    """The first side has counts, the second only its time: both from one explode."""
    i = F.col("id")
    side = lambda who, strikes: F.struct(F.col(who).alias("entity"), strikes.cast("long").alias("strikes"), (5 + i % 10).alias("minutes"))
    rows = contests(spark, folder).select(F.explode(F.array(side("a", i % 7), side("b", F.lit(0)))).alias("s")).select("s.*")
    return rows.groupBy("entity").agg(F.sum("strikes").alias("strikes"), F.sum("minutes").alias("minutes"))


@query("so3_last_by_date", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def so3(spark, folder):
    return table(spark, folder, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey")


@query("so7_pairs_for_a_trial", "SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier ORDER BY s_suppkey LIMIT 20")
def so7(spark, folder):
    """The first pairs in a fixed order: the limit is the feature."""
    return table(spark, folder, "supplier").orderBy("s_suppkey").limit(20).select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))


@query("st7_train_and_validation", "SELECT o_orderkey, 'train' AS part FROM orders WHERE o_orderdate < '1997-01-01' UNION ALL SELECT o_orderkey, 'val' FROM orders WHERE o_orderdate >= '1997-01-01'")
def st7(spark, folder):
    o = table(spark, folder, "orders")
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return o.filter(early).select("o_orderkey", F.lit("train").alias("part")).unionByName(o.filter(~early).select("o_orderkey", F.lit("val").alias("part")))


@query("fn2_fn3_folded", f"SELECT doc_id, translate(lower(text), '{T.MARKED}', '{T.PLAIN}') AS folded FROM documents")
def fn3(spark, folder):
    """Letters without marks in one pass instead of a chain of replacements."""
    return table(spark, folder, "documents").select("doc_id", T.folded(F.col("text")).alias("folded"))


@query("fn6_tiered_lookup", """WITH n AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) WHEN s_suppkey % 3 = 1 THEN right(s_name, 4) ELSE 'none' END AS asked FROM supplier),
t AS (SELECT n.s_suppkey, min(CASE WHEN lower(x.s_name) = asked THEN 1 WHEN right(x.s_name, 4) = asked THEN 2 END) AS tier FROM n LEFT JOIN supplier x ON lower(x.s_name) = asked OR right(x.s_name, 4) = asked GROUP BY 1) SELECT * FROM t""")
def fn6(spark, folder):
    """Whole name first, then its last part: one equi-join over the tiers' keys, the best tier wins."""
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    keys = s.select(F.explode(F.array(F.struct(F.lower("s_name").alias("key"), F.lit(1).alias("tier")), F.struct(F.right("s_name", F.lit(4)).alias("key"), F.lit(2).alias("tier")))).alias("t")).select("t.*").distinct()
    asked = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lower("s_name")).when(F.col("s_suppkey") % 3 == 1, F.right("s_name", F.lit(4))).otherwise("none").alias("key"))
    return asked.join(keys, "key", "left").groupBy("s_suppkey").agg(F.min("tier").alias("tier"))


@query("fn11_pounds", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS pounds FROM part")
def fn11(spark, folder):
    weight = F.when(F.col("p_size") % 5 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" lbs."))).otherwise("--")
    return table(spark, folder, "part").select("p_partkey", T.pounds(weight).alias("pounds"))


@query("fn18_labels_to_fields", "SELECT s_suppkey, s_name AS name, s_nationkey::VARCHAR AS home FROM supplier")
def fn18(spark, folder):
    """Rows of label and value become the fields that the labels name."""
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), F.col(value).cast("string").alias("value"))
    rows = table(spark, folder, "supplier").select("s_suppkey", F.explode(F.array(pair("Full name:", "s_name"), pair("Hometown", "s_nationkey"), pair("Other", "s_acctbal"))).alias("p"))
    return T.routed(rows.select("s_suppkey", "p.label", "p.value"), "s_suppkey", {"name": "name", "home": "hometown"})


WHEN = "CASE WHEN regexp_extract(t, '20[12][0-9]') <> '' AND m IS NOT NULL THEN make_date(regexp_extract(t, '20[12][0-9]')::INT, m, 15) ELSE DATE '2025-01-01' - CASE " + " ".join(f"WHEN regexp_matches(t, '{x}') THEN {n}" for x, n in T.AGO) + " ELSE 180 END END::DATE"
MONTH = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN {i}" for i, m in enumerate(T.MONTHS, 1)) + " END"


@query("fn24_injury_dates", f"""SELECT doc_id, {WHEN} AS d FROM (SELECT *, {MONTH} AS m FROM (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 7 WHEN 0 THEN ' March 2024' WHEN 1 THEN ' out since last month' WHEN 2 THEN ' hurt this week' WHEN 3 THEN ' recently hurt' ELSE '' END) AS t FROM documents))""")
def fn24(spark, folder):
    """When an injury was, from what the text says about it."""
    i = F.col("doc_id") % 7
    more = F.when(i == 0, " March 2024").when(i == 1, " out since last month").when(i == 2, " hurt this week").when(i == 3, " recently hurt").otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), more)
    return table(spark, folder, "documents").select("doc_id", T.injury_date(text, F.lit("2025-01-01").cast("date")).alias("d"))


@query("str4_dm86_stale_checks", "SELECT user_id, max(ts) AS last, date_diff('day', max(ts), TIMESTAMP '2024-02-15') > 7 AS stale FROM events GROUP BY 1")
def str4(spark, folder):
    """Whose last check is older than a week at a given day."""
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", "last", (F.datediff(F.lit("2024-02-15").cast("date"), F.to_date("last")) > 7).alias("stale"))


@query("dm19_point_in_time_stats", "WITH " + HISTORY + """, one AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY entity, d::DATE ORDER BY d, id) = 1)
SELECT id, count(*) OVER w AS n_before, coalesce(sum((result = 'win')::INT) OVER w, 0)::BIGINT AS wins, coalesce(sum((result = 'loss')::INT) OVER w, 0)::BIGINT AS losses FROM one WINDOW w AS (PARTITION BY entity ORDER BY d, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def dm19(spark, folder):
    from ringledger.operators import history as H

    return H.point_in_time(history(spark, folder)).select("id", "n_before", F.col("wins").cast("long").alias("wins"), F.col("losses").cast("long").alias("losses"))


@query("dm63_events_by_keywords", "SELECT p_partkey, score FROM (SELECT p_partkey, (contains(lower(p_name), 'red'))::INT + 3 * (contains(lower(p_name), 'bolt'))::INT + 3 * (contains(lower(p_name), 'ring'))::INT AS score FROM part) WHERE score > 0")
def dm63(spark, folder):
    """Titles that share words with a search, with their score."""
    return table(spark, folder, "part").select("p_partkey", T.event_score(F.col("p_name"), "red bolt vs. ring").alias("score")).filter("score > 0")


@query("dm73_age_if_absent", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey + 20 ELSE (date_diff('day', DATE '1980-01-01' + c_nationkey * 100, DATE '2024-01-01') // 365)::INT END AS age FROM customer")
def dm73(spark, folder):
    """A stated age stays, else it comes from the date of birth."""
    born = F.date_add(F.lit("1980-01-01").cast("date"), F.col("c_nationkey") * 100)
    stated = F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") + 20)
    return table(spark, folder, "customer").select("c_custkey", F.coalesce(stated, F.floor(F.datediff(F.lit("2024-01-01").cast("date"), born) / 365)).cast("int").alias("age"))


@query("dm88_routed_warnings", "SELECT 'supplier' AS kind, s_suppkey AS k, 'balance' AS rule FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'customer', c_custkey, 'balance' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'customer', c_custkey, 'segment' FROM customer WHERE c_mktsegment = 'BUILDING'")
def dm88(spark, folder):
    """Each kind of item has rules of its own; only warnings come out, nothing is dropped before."""
    kinds = {"supplier": ("s_suppkey", {"balance": F.col("s_acctbal") >= 0}), "customer": ("c_custkey", {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"})}
    out = None
    for kind, (key, found) in kinds.items():
        one = rules.warnings_of(table(spark, folder, kind), found, [key]).select(F.lit(kind).alias("kind"), F.col(key).alias("k"), "rule")
        out = one if out is None else out.unionByName(one)
    return out


@query("dm70_weekly_run", "SELECT * FROM (VALUES (1, 'load', 'done'), (2, 'validate', 'done'), (3, 'rate', 'failed'), (4, 'adjust', 'not run')) t(step, name, state)")
def dm70(spark, folder):
    """Steps in order of their priority; the first failure ends the run."""
    steps = {"load": (1, lambda: table(spark, folder, "orders").count()), "rate": (3, lambda: 1 // 0), "validate": (2, lambda: 0), "adjust": (4, lambda: 0)}
    return spark.createDataFrame(managed.run_steps(steps), "step int, name string, state string")


@query("ud2_row_function", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def ud2(spark, folder):
    """A function of several columns of a row as one expression."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(charge).alias("charge"))


@query("dm80_profile_attributes", "SELECT o_orderkey, c_nationkey, c_mktsegment, 1500 + c_acctbal / 20 AS rating FROM orders JOIN customer ON o_custkey = c_custkey")
def dm80(spark, folder):
    """What ratings need of a profile joins the contests before they are rated."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (1500 + F.col("c_acctbal") / 20).alias("rating"))
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey").drop("c_custkey")


@query("dm8_estimates_compared", "WITH " + HISTORY + ", r AS (SELECT entity, count(*) FILTER (result = 'win') AS w, count(*) FILTER (result = 'loss') AS l FROM history GROUP BY 1) SELECT entity, round((15 * ln(w + 1) - 20 * ln(l + 1)) - (w - l) * 10, 4) AS diff FROM r")
def dm8(spark, folder):
    """A simple estimate against the enhanced one, entity by entity."""
    r = history(spark, folder).groupBy("entity").agg(F.count_if(F.col("result") == "win").alias("w"), F.count_if(F.col("result") == "loss").alias("l"))
    return r.select("entity", F.round(15 * F.ln(F.col("w") + 1) - 20 * F.ln(F.col("l") + 1) - (F.col("w") - F.col("l")) * 10, 4).alias("diff"))

