"""Queries of stored state: item streams, tables that change by buckets, stages with restart, progress, pages read by a tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringledger.functions import pages as PG
from ringledger.functions import ratings as R
from ringledger.operators import keyed, markets, progress, resolution, stages, stats
from ringledger.plans.base import PREDICTION, Module, predictions, r6
from ringledger.plans.domain import RATED, rated
from ringledger.sources.bucketed import BucketedTable
from ringledger.sources.files import scratch
from ringledger.sources.tables import table
from ringledger.streaming import items

M = Module()
query = M.query


@query("str1_item_stream", """WITH e AS (SELECT user_id AS entity, event_id, ts, event_type = 'purchase' AS won, coalesce(value, 0) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT entity, count(*) AS n, count(*) FILTER (won) AS wins, min(ts) AS first, max(ts) AS last, round(avg(value) FILTER (back <= 5), 6) AS last5_mean, count(*) FILTER (won AND back <= 3) AS last3_wins FROM e GROUP BY 1""")
def str1(spark, folder):
    """Events arrive one file after the other; totals are state, flushed by the timer once the stream is closed."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("long").alias("entity"), F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("won"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    stream = items.arriving(spark, items.as_arrivals(e, 4), per_trigger=3)
    done = items.drive(items.totals(stream, 400 * 86400), scratch(spark), scratch(spark))
    return done.select("entity", "n", "wins", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), r6("last5_mean").alias("last5_mean"), "last3_wins")


@query("snk16_bucketed_upsert", """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderstatus END AS state, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS x FROM orders
UNION ALL SELECT -1 - c_custkey, 'new', c_acctbal FROM customer""")
def snk16(spark, folder):
    """A keyed table, a delta of changed rows and one of new rows: each rewrites the buckets that it touches."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").cast("double").alias("x"))
    kept = BucketedTable.create(o, scratch(spark), ["k"], 16)
    kept.upsert(o.filter("state = 'P'").select("k", F.lit("changed").alias("state"), (-F.col("x")).alias("x")))
    kept.upsert(table(spark, folder, "customer").select((-1 - F.col("c_custkey")).cast("long").alias("k"), F.lit("new").alias("state"), F.col("c_acctbal").cast("double").alias("x")))
    return kept.read()


def order_stages() -> list[stages.Stage]:
    """Required fields, cleaning, merge with the customer, the active ones, ranges, repeats, statistics."""
    return [
        stages.Stage("validated", 100, lambda t: t["orders"].filter("o_orderkey is not null and o_custkey is not null")),
        stages.Stage("cleaned", 120, lambda t: t["validated"].select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.lower(F.trim(F.substring_index("o_orderpriority", "-", -1))).alias("priority"), F.col("o_totalprice").cast("double").alias("price"))),
        stages.Stage("merged", 125, lambda t: t["cleaned"].join(t["customer"].select(F.col("c_custkey").alias("_c"), "c_nationkey"), F.col("o_custkey") == F.col("_c"), "left").drop("_c")),
        stages.Stage("active", 130, lambda t: t["merged"].filter("day >= date '1995-01-01'")),
        stages.Stage("ranged", 150, lambda t: t["active"].filter("price between 1 and 400000")),
        stages.Stage("distinct", 200, lambda t: keyed.first_per_key(t["ranged"], ["o_custkey", "day"], ["o_orderkey"])),
        stages.Stage("statistics", 250, lambda t: t["distinct"].groupBy("c_nationkey", "priority").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))),
    ]


@query("dm72_stages_by_priority", """WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day, lower(trim(substring(o_orderpriority, strpos(o_orderpriority, '-') + 1))) AS priority, o_totalprice AS price FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL),
m AS (SELECT v.*, c_nationkey FROM v LEFT JOIN customer ON o_custkey = c_custkey WHERE day >= DATE '1995-01-01' AND price BETWEEN 1 AND 400000),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey, day ORDER BY o_orderkey) = 1) SELECT c_nationkey, priority, count(*) AS n, round(sum(price), 2) AS total FROM d GROUP BY 1, 2""")
def dm72(spark, folder):
    """Seven stages, the first run broken before the last but one; the second run goes on from there."""
    home, sources = scratch(spark), {"orders": table(spark, folder, "orders"), "customer": table(spark, folder, "customer")}
    plan = order_stages()

    def stop(tables):
        raise OSError("the first run ends here")

    stages.run(spark, home, [*plan[:5], stages.Stage("distinct", 200, stop), plan[6]], sources)
    tables, _ = stages.run(spark, home, plan, sources)
    return tables["statistics"]


@query("ud5_progress_counters", "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, max(o_totalprice) AS highest FROM orders")
def ud5(spark, folder):
    """Counters that leave the write of a table, without a pass of their own."""
    seen_rows, seen = progress.observed(table(spark, folder, "orders"), "orders", n=F.count(F.lit(1)), finished=F.count_if(F.col("o_orderstatus") == "F"), highest=F.max("o_totalprice"))
    seen_rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["n"], got["finished"], float(got["highest"]))], "n long, finished long, highest double")


#: Pages of suppliers: the heading or the title has the name, every seventh is cut off in the middle, labels come in two orders.
ATHLETE = """concat('<html><head><title>', s_name, ' | Ring</title></head><body>', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('<h1 class="hero__name big"> ', s_name, ' </h1>') END,
 '<p class="hero__nick">&quot;The ', s_suppkey, '&quot;<br></p><div class="hero__division"><span>no</span>Heavy &amp; Co', '<p class="hero__record">', s_suppkey % 30, '-', s_suppkey % 7, '-', s_suppkey % 2, ' (W-L-D)</p>',
 '<div class="bio"><div class="bio__label">', CASE WHEN s_suppkey % 2 = 0 THEN 'Hometown' ELSE 'Reach' END, '</div><div class="bio__text">', s_nationkey, '</div><div class="bio__label">Age</div>',
 CASE WHEN s_suppkey % 7 = 0 THEN '<div class="bio__te' ELSE concat('<div class="bio__text">', 20 + s_nationkey, '</div></div></body></html>') END) AS html"""


@query("src13_athlete_pages", """SELECT s_suppkey, s_name AS name, concat('"The ', s_suppkey, '"') AS nick, 'Heavy & Co' AS division, concat(s_suppkey % 30, '-', s_suppkey % 7, '-', s_suppkey % 2, ' (W-L-D)') AS record, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END AS hometown, CASE WHEN s_suppkey % 2 = 1 THEN s_nationkey::VARCHAR END AS reach, CASE WHEN s_suppkey % 7 <> 0 THEN (20 + s_nationkey)::VARCHAR END AS age FROM supplier""")
def src13(spark, folder):
    """Name by heading or else title, nickname, division, record and the labelled list of an athlete's page."""
    made = table(spark, folder, "supplier").select("s_suppkey", F.expr(ATHLETE))
    wanted = {"name": (("h1", "hero__name"), ("title", None)), "nick": (None, "hero__nick"), "division": (None, "hero__division"), "record": (None, "hero__record")}
    got = PG.fields(made, "s_suppkey", "html", wanted, "bio__label", "bio__text", {"hometown": "Hometown", "reach": "Reach", "age": "Age"})
    return got.withColumn("name", F.trim(F.substring_index("name", "|", 1)))


@query("src17_src21_card_of_page", """WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS n, l_suppkey, l_partkey, l_quantity FROM lineitem)
SELECT l_orderkey, n::INTEGER AS n, l_suppkey::VARCHAR AS red, l_partkey::VARCHAR AS blue, CASE WHEN l_quantity > 25 THEN l_suppkey::VARCHAR ELSE l_partkey::VARCHAR END AS winner, CASE WHEN l_quantity % 2 = 0 THEN 'KO/TKO' ELSE 'Decision' END AS method, (1 + l_quantity::INT % 5) AS round FROM l""")
def src17(spark, folder):
    """A card's page has a row for each contest, and in it a table of its own with winner, method and round."""
    q = F.col("l_quantity").cast("int")
    inner = F.concat(F.lit("<table><tr><th>Winner<th>Method<th>Round</tr><tr><td>"), F.when(q > 25, F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("string"), F.lit("<td>"), F.when(q % 2 == 0, "KO/TKO").otherwise("Decision"), F.lit("</td><td> "), (1 + q % 5).cast("string"), F.lit("</table>"))
    row = F.concat(F.lit("<tr><td><b>"), F.col("l_suppkey").cast("string"), F.lit("</b></td><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), inner, F.lit("</td></tr>"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("r")))).alias("rs"))  # the lines of an order
    made = lines.select("l_orderkey", F.concat(F.lit("<html><body><p>Card</p></div><table class=card>"), F.array_join("rs.r", ""), F.lit("</table></body>")).alias("html"))
    rows = PG.table_rows(made, "l_orderkey", "html")
    # pages are parsed once: a nested table meets the row it stands in by the page's key and that row
    here = F.when(F.col("parent").isNull(), F.col("row")).otherwise(F.col("parent_row"))
    kept = rows.filter("parent is null or (parent = 0 and row = 1)").withColumn("n", here)
    outer, told = (F.max(F.when(which, F.col("cells"))) for which in (F.col("parent").isNull(), F.col("parent").isNotNull()))
    each = kept.groupBy("l_orderkey", "n").agg(outer.alias("o"), told.alias("t")).filter("o is not null and t is not null")
    return each.select("l_orderkey", "n", F.col("o")[0].alias("red"), F.col("o")[1].alias("blue"), F.col("t")[0].alias("winner"), F.col("t")[1].alias("method"), F.col("t")[2].cast("int").alias("round"))


_PMF = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({0}) + (n - i) * ln(1 - {0}))"
_TWO_SIDED = "least(1, list_sum(list_filter(list_transform(range(0, n + 1), lambda i: " + _PMF + "), lambda x: x <= 1.0000001 * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({0}) + (n - k) * ln(1 - {0})))))"


@query("dm54_edge_shortlist", "WITH " + RATED + f""", s AS (SELECT na AS nation, count(*) AS n, count(*) FILTER (won) AS k, avg(p) AS expected FROM q GROUP BY 1), t AS (SELECT *, k / n AS rate, {_TWO_SIDED.format('0.5::DOUBLE')} AS pv FROM s)
SELECT nation, n, round(rate, 6) AS rate, round(rate - expected, 6) AS edge, round(pv, 6) AS p_value, CASE WHEN n < 100 THEN 'insufficient data' ELSE concat_ws(', ', CASE WHEN pv > 0.05 / 30 THEN 'not significant' END, CASE WHEN abs(rate - expected) < 0.03 THEN 'too small' END) END AS warnings, n >= 100 AND pv < 0.05 / 30 AND abs(rate - expected) >= 0.05 AS valid, n >= 100 AS usable
FROM t WHERE n >= 20 AND abs(rate - expected) > 0.02""")
def dm54(spark, folder):
    """Nations whose side wins otherwise than the ratings expect, with samples, exact test, correction and size checked."""
    s = rated(spark, folder).groupBy(F.col("na").alias("nation")).agg(F.count("*").alias("n"), F.count_if("won").alias("k"), F.avg("p").alias("expected"))
    t = s.withColumn("rate", F.col("k") / F.col("n")).filter((F.col("n") >= 20) & (F.abs(F.col("rate") - F.col("expected")) > 0.02)).withColumn("pv", stats.binomial_two_sided("k", "n", F.lit(0.5)))
    v = stats.edge_verdict(F.col("n"), F.col("rate"), F.col("expected"), F.col("pv"))
    return t.select("nation", "n", r6("rate").alias("rate"), r6(F.col("rate") - F.col("expected")).alias("edge"), r6("pv").alias("p_value"), F.array_join(v["warnings"], ", ").alias("warnings"), v["valid"].alias("valid"), v["usable"].alias("usable"))


@query("dm58_edge_tests", "WITH " + PREDICTION + f""", s AS (SELECT kind, date_trunc('month', d)::DATE AS month, count(*) AS n, count(*) FILTER (won) AS k, avg(p) AS expected FROM prediction GROUP BY 1, 2), t AS (SELECT *, {_TWO_SIDED.format('expected')} AS pv FROM s)
SELECT kind, month, n, round(pv, 6) AS p_value, (n < 20)::INT + (pv > 0.05 / 20)::INT + (abs(k / n - expected) < 0.03)::INT + (k / n - expected - 1.96 * sqrt((k / n) * (1 - k / n) / n) < 0)::INT AS warnings FROM t""")
def dm58(spark, folder):
    """An edge's four checks: samples, two-sided binomial test at a twentieth of the level, practical size, interval."""
    s = predictions(spark, folder).groupBy("kind", F.to_date(F.date_trunc("month", "d")).alias("month")).agg(F.count("*").alias("n"), F.count_if("won").alias("k"), F.avg("p").alias("expected"))
    rate = F.col("k") / F.col("n")
    t = s.withColumn("pv", stats.binomial_two_sided("k", "n", "expected"))
    found = (F.col("n") < 20).cast("int") + (F.col("pv") > 0.05 / 20).cast("int") + (F.abs(rate - F.col("expected")) < 0.03).cast("int") + (rate - F.col("expected") - 1.96 * F.sqrt(rate * (1 - rate) / F.col("n")) < 0).cast("int")
    return t.select("kind", "month", "n", r6("pv").alias("p_value"), found.alias("warnings"))


_WORDS = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('the', 'and', 'vs'))))"


@query("dm63_events_by_tiers", f"""WITH k AS (SELECT min(p_partkey) AS id, ws FROM (SELECT p_partkey, {_WORDS.format('p_name')} AS ws FROM part) WHERE len(ws) > 0 GROUP BY ws),
a AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN item_id END AS asked, {_WORDS.format("CASE item_id % 4 WHEN 1 THEN (SELECT any_value(p_name) FROM part WHERE p_partkey = item_id) ELSE concat('vs. RED bolt the ', item_id, ' ', left(text, 30)) END")} AS ws FROM benchmark),
c AS (SELECT item_id, 1 AS tier, 0 AS score, p_partkey AS id FROM a JOIN part ON asked = p_partkey UNION ALL SELECT item_id, 2, 0, k.id FROM a JOIN k ON a.ws = k.ws
 UNION ALL SELECT * FROM (SELECT item_id, 3, list_sum(list_transform(list_intersect(a.ws, k.ws), lambda w: CASE WHEN length(w) >= 4 THEN 3 ELSE 1 END))::INTEGER AS score, k.id FROM a, k) WHERE score >= 4),
b AS (SELECT item_id, arg_min({{'tier': tier, 'score': score, 'id': id}}, (tier, -score, id)) AS m FROM c GROUP BY 1)
SELECT a.item_id, m.tier AS tier, m.score AS score, m.id AS event_id FROM a LEFT JOIN b ON a.item_id = b.item_id""")
def dm63(spark, folder):
    """Asked events in three ways: by a part's key, by its whole name, by words of which some are a part's."""
    known = table(spark, folder, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_name").alias("title"))
    turn = F.pmod("item_id", F.lit(4))
    asked = table(spark, folder, "benchmark").join(known.toDF("_p", "_title"), F.col("item_id") == F.col("_p"), "left")
    loose = F.concat(F.lit("vs. RED bolt the "), F.col("item_id").cast("string"), F.lit(" "), F.left("text", F.lit(30)))
    asked = asked.select("item_id", F.when(turn == 0, F.col("item_id")).alias("event_id"), F.when(turn == 1, F.col("_title")).otherwise(loose).alias("title"))
    return resolution.events(asked, known, "item_id")


@query("ud4_caller_strategies", "WITH " + RATED + """, o AS (SELECT won, p, greatest(1.05, 1 + (id % 40) / 10.0::DOUBLE) AS da, greatest(1.05, 1 + (id % 37) / 10.0::DOUBLE) AS db FROM q),
s AS (SELECT 'favourite' AS strategy, CASE WHEN p >= 0.5 THEN da ELSE db END AS dec, CASE WHEN p >= 0.5 THEN won ELSE NOT won END AS hit FROM o
 UNION ALL SELECT 'value', CASE WHEN p * da - 1 > 0.1 THEN da ELSE db END, CASE WHEN p * da - 1 > 0.1 THEN won ELSE NOT won END FROM o WHERE p * da - 1 > 0.1 OR (1 - p) * db - 1 > 0.1
 UNION ALL SELECT 'underdog above two', da, won FROM o WHERE p < 0.4 AND da > 2)
SELECT strategy, count(*) AS n, round(avg(hit::INT), 6) AS rate, round(sum(CASE WHEN hit THEN dec - 1 ELSE -1 END), 4) AS profit, round(sum(CASE WHEN hit THEN dec - 1 ELSE -1 END) / count(*), 6) AS roi FROM s GROUP BY 1""")
def ud4(spark, folder):
    """Strategies are functions of the caller that give a bet or null for a row; all are evaluated in one pass."""
    rows = rated(spark, folder).select("won", "p", F.greatest(F.lit(1.05), 1 + F.pmod("id", F.lit(40)) / 10.0).alias("da"), F.greatest(F.lit(1.05), 1 + F.pmod("id", F.lit(37)) / 10.0).alias("db"))
    p, da, db = F.col("p"), F.col("da"), F.col("db")
    bet = lambda side, decimal: F.struct(F.lit(side).alias("side"), decimal.alias("decimal"))
    own = {
        "favourite": lambda: F.when(p >= 0.5, bet("a", da)).otherwise(bet("b", db)),
        "value": lambda: F.when(p * da - 1 > 0.1, bet("a", da)).when((1 - p) * db - 1 > 0.1, bet("b", db)),
        "underdog above two": lambda: F.when((p < 0.4) & (da > 2), bet("a", da)),
    }
    out = markets.by_strategy(rows, own)
    return out.select("strategy", "n", r6("rate").alias("rate"), F.round("profit", 4).alias("profit"), r6("roi").alias("roi"))


@query("snk23_checks_written", """WITH c AS (SELECT s_suppkey AS entity, s_nationkey AS days, 1500 + s_acctbal / 20 AS rating, CASE WHEN s_nationkey % 3 = 0 THEN 'major' WHEN s_nationkey % 3 = 1 THEN 'minor' END AS severity FROM supplier),
p AS (SELECT *, CASE severity WHEN 'major' THEN 82 WHEN 'minor' THEN 37 ELSE 0 END AS penalty FROM c) SELECT entity, 2::BIGINT AS checks, severity, penalty, round(rating - penalty, 6) AS adjusted FROM p""")
def snk23(spark, folder):
    """Two runs of checks: each is appended to the log, the profile gets the last penalty and the adjusted rating by an upsert."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("long").alias("entity"), F.col("s_nationkey").alias("days"), (1500 + F.col("s_acctbal") / 20).alias("rating"))
    kind = F.when(F.col("days") % 3 == 0, "major").when(F.col("days") % 3 == 1, "minor")
    log = scratch(spark)
    profile = BucketedTable.create(s.select("entity", "rating", F.lit(None).cast("string").alias("severity"), F.lit(0).alias("penalty"), F.col("rating").alias("adjusted")), scratch(spark), ["entity"], 8)
    for turn in (1, 2):
        checks = s.select("entity", "rating", F.lit(turn).alias("turn"), kind.alias("severity"), R.injury_penalty(kind, F.col("days")).alias("penalty"))
        checks.drop("rating").write.mode("append").parquet(log)
        profile.upsert(checks.select("entity", "rating", "severity", "penalty", (F.col("rating") - F.col("penalty")).alias("adjusted")))
    seen = spark.read.parquet(log).groupBy(F.col("entity").alias("_e")).agg(F.count("*").alias("checks"))
    return profile.read().join(seen, F.col("entity") == F.col("_e")).select("entity", "checks", "severity", "penalty", r6("adjusted").alias("adjusted"))
