"""Sources, sinks, DDL and DML as queries (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringledger.functions import text as T
from ringledger.operators import keyed
from ringledger.plans.base import Module, r6
from ringledger.sources import files
from ringledger.sources.tables import table

M = Module()
query = M.query


@query("src1_csv_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src1(spark, folder):
    """Written as CSV with a header, read back with a declared schema."""
    suppliers = table(spark, folder, "supplier")
    return files.read_csv(spark, files.write_csv(suppliers), suppliers.schema)


@query("src2_keyed_last_wins", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def src2(spark, folder):
    return keyed.first_per_key(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("src3_json_scan", "SELECT n_nationkey, n_name FROM nation")
def src3(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return files.read_json(spark, files.write_json(nations), nations.schema)


@query("src6_named_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def src6(spark, folder):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 300000, "status": "F"}, orders=table(spark, folder, "orders"))


@query("src9_catalog", "SELECT column_name AS name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE data_type END AS kind FROM (DESCRIBE SELECT * FROM nation) t(column_name, data_type, n, k, d, e)")
def src9(spark, folder):
    return files.columns_of(table(spark, folder, "nation"))


@query("src10_page_links", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS link FROM pages")
def src10(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.explode(F.array_distinct(T.links(F.col("html")))).alias("link"))


@query("src11_page_to_rows", "SELECT page_id, 'title' AS kind, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS value FROM pages WHERE regexp_matches(html, '<title>[^<]*</title>') UNION ALL SELECT page_id, 'paragraph', trim(unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1))) FROM pages")
def src11(spark, folder):
    html = F.col("html")
    title = F.when(html.rlike("<title>[^<]*</title>"), F.array(F.struct(F.lit("title").alias("kind"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("value")))).otherwise(F.array())
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit("<p>([^<]*)</p>"), F.lit(1)), lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("value")))
    return table(spark, folder, "pages").select("page_id", F.explode(F.concat(title, paragraphs)).alias("r")).select("page_id", "r.kind", F.trim("r.value").alias("value"))


@query("src14_blocking_lookup", "SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM customer JOIN supplier ON right(c_name, 2) = right(s_name, 2) AND c_nationkey = s_nationkey GROUP BY 1")
def src14(spark, folder):
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return c.join(s, (F.right("c_name", F.lit(2)) == F.right("s_name", F.lit(2))) & (c.c_nationkey == s.s_nationkey)).groupBy("c_custkey").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("src15_second_source_fills", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, s_acctbal) AS balance FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def src15(spark, folder):
    base = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    other = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    return keyed.fill_only(base, other, ["c_custkey"], ["balance"])


@query("src16_rows_paired", """SELECT l_orderkey, (n - 1) // 2 AS pair, max(CASE WHEN n % 2 = 1 THEN l_extendedprice END) AS first, max(CASE WHEN n % 2 = 0 THEN l_extendedprice END) AS second
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) GROUP BY 1, 2""")
def src16(spark, folder):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, folder, "lineitem").withColumn("n", n.cast("long"))
    return rows.groupBy("l_orderkey", F.floor((F.col("n") - 1) / 2).cast("long").alias("pair")).agg(F.max(F.when(F.col("n") % 2 == 1, F.col("l_extendedprice"))).alias("first"), F.max(F.when(F.col("n") % 2 == 0, F.col("l_extendedprice"))).alias("second"))


@query("src16_array_odds", "SELECT l_orderkey, max(l_discount) AS best, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1")
def src16b(spark, folder):
    each = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("odds"))
    mean = F.aggregate("odds", F.lit(0.0), lambda s, x: s + x) / F.size("odds")
    return each.select("l_orderkey", F.array_max("odds").alias("best"), r6(mean).alias("mean"), F.size("odds").cast("long").alias("n"))


@query("src18_pattern_rows", "SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM (SELECT regexp_extract(t, '^(\\w+) of (\\w+)$', 1) AS a, regexp_extract(t, '^(\\w+) of (\\w+)$', 2) AS b FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+ of [a-z]+')) AS t FROM documents WHERE lang = 'en'))")
def src18(spark, folder):
    """'A of B' in text, one row for each unordered pair."""
    found = table(spark, folder, "documents").filter("lang = 'en'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ of [a-z]+"), F.lit(0))).alias("t"))
    pair = F.array_sort(F.split("t", " of "))
    return found.select(pair[0].alias("x"), pair[1].alias("y")).distinct()


@query("src19_first_in_order", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY 1")
def src19(spark, folder):
    return keyed.first_per_key(table(spark, folder, "pages"), ["url"], ["page_id"]).select("url", "page_id")


@query("src20_best_implied", "SELECT l_orderkey, round(1 / max(1 + l_tax), 6) AS implied FROM lineitem GROUP BY 1")
def src20(spark, folder):
    best = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max(1 + F.col("l_tax")).alias("best"))
    return best.select("l_orderkey", r6(1 / F.col("best")).alias("implied"))


@query("src22_visible_text", r"""SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<nav\b.*?</nav>', ' ', 'gis'), '<footer\b.*?</footer>', ' ', 'gis'), '<header\b.*?</header>', ' ', 'gis'),
 '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))) AS visible FROM pages""")
def src22(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.visible_text(F.col("html")).alias("visible"))


@query("src23_first_five_links", "SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: contains(lower(x), 'a'))[1:5], ' ') AS l FROM pages")
def src23(spark, folder):
    kept = F.filter(T.links(F.col("html")), lambda x: F.lower(x).contains("a"))
    return table(spark, folder, "pages").select("page_id", F.array_join(F.slice(kept, 1, 5), " ").alias("l"))


@query("src24_pair_list", "SELECT trim(split_part(x, ',', 1)) AS a, trim(split_part(x, ',', 2)) AS b FROM (SELECT r_name || ', ' || n_name AS x FROM region JOIN nation ON n_regionkey = r_regionkey)")
def src24(spark, folder):
    r, n = table(spark, folder, "region"), table(spark, folder, "nation")
    lines = r.join(n, r.r_regionkey == n.n_regionkey).select(F.concat("r_name", F.lit(", "), "n_name").alias("x"))
    return lines.select(F.trim(F.split("x", ",")[0]).alias("a"), F.trim(F.split("x", ",")[1]).alias("b"))


@query("snk3_nested_history", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def snk3(spark, folder):
    """Key with a list of structs, written as JSON and read back."""
    nested = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("history"))
    back = files.read_json(spark, files.write_json(nested), nested.schema)
    return back.select("o_custkey", F.size("history").cast("long").alias("n"), F.element_at("history", -1)["o_orderkey"].alias("last"))


@query("snk9_filtered_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P')")
def snk9(spark, folder):
    return keyed.delete_where(table(spark, folder, "orders"), F.col("o_orderstatus") == "P").select("o_orderkey")


@query("snk10_upsert", """WITH delta AS (SELECT s_suppkey + 50 AS s_suppkey, s_name || '*' AS s_name, s_acctbal FROM supplier)
SELECT s_suppkey, s_name, s_acctbal FROM delta UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM delta)""")
def snk10(spark, folder):
    base = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    delta = base.select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.concat("s_name", F.lit("*")).alias("s_name"), "s_acctbal")
    return keyed.upsert(base, delta, ["s_suppkey"])


@query("snk12_fallback_key", "SELECT coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END, concat_ws('|', o_custkey, strftime(o_orderdate, '%Y-%m-%d'))) AS key, count(*) AS n FROM orders GROUP BY 1")
def snk12(spark, folder):
    key = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")), F.concat_ws("|", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, folder, "orders").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("snk13_append_bad_rows_skipped", "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer WHERE TRY_CAST(substr(c_name, 10) AS BIGINT) IS NOT NULL")
def snk13(spark, folder):
    n = F.substr("c_name", F.lit(10)).try_cast("long")
    return table(spark, folder, "customer").select("c_custkey", n.alias("number")).filter("number is not null")


@query("snk14_json_breakdown", "SELECT s_suppkey, '{\"nation\":' || s_nationkey || ',\"name\":\"' || s_name || '\"}' AS j FROM supplier")
def snk14(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))).alias("j"))


@query("snk18_fill_only", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, -1.0::DOUBLE) AS s_acctbal FROM supplier")
def snk18(spark, folder):
    base = table(spark, folder, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("s_acctbal"))
    return keyed.fill_only(base, base.select("s_suppkey", F.lit(-1.0).alias("s_acctbal")), ["s_suppkey"], ["s_acctbal"])


@query("snk20_one_hour_rule", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p > INTERVAL 1 HOUR")
def snk20(spark, folder):
    return keyed.suppress_repeats(table(spark, folder, "events"), ["user_id", "event_type"], "ts", 3600, "event_id").select("event_id")


@query("snk21_resolve", "SELECT o.o_orderkey, coalesce(x.status, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN (SELECT l_orderkey, 'R' AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON l_orderkey = o_orderkey")
def snk21(spark, folder):
    base = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    delta = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("o_orderstatus", F.lit("R"))
    return keyed.override(base, delta, ["o_orderkey"], ["o_orderstatus"])


@query("snk24_add_column", "SELECT n_nationkey, NULL::VARCHAR AS country, n_name FROM nation")
def snk24(spark, folder):
    return keyed.add_missing_columns(table(spark, folder, "nation").select("n_nationkey", "n_name"), {"country": "string", "n_name": "string"})


@query("snk27_null_to_zero", "SELECT sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END)::BIGINT AS before, 0::BIGINT AS after, round(sum(coalesce(x, 0)), 2) AS total FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer)")
def snk27(spark, folder):
    raw = table(spark, folder, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x"))
    return raw.withColumn("was_null", F.col("x").isNull()).fillna(0.0, ["x"]).agg(F.count_if("was_null").alias("before"), F.count_if(F.col("x").isNull()).alias("after"), F.round(F.sum("x"), 2).alias("total"))


@query("snk29_table_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def snk29(spark, folder):
    out = None
    for name in ("customer", "orders", "lineitem"):
        one = table(spark, folder, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
