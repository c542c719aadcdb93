"""Scalar functions as queries (FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringledger.functions import markets as MK
from ringledger.functions import ratings as R
from ringledger.functions import text as T
from ringledger.plans.base import Module, r6
from ringledger.sources.tables import table

M = Module()
query = M.query
MARKS = f"translate(lower(x), '{T.MARKED}', '{T.PLAIN}')"


@query("fn1_plain_name", f"SELECT doc_id, trim(regexp_replace(trim(regexp_replace({MARKS}, '\\s+', ' ', 'g')), ' (jr|sr|ii|iii|iv)\\.?$', '')) AS name FROM (SELECT doc_id, text || ' Jr.' AS x FROM documents)")
def fn1(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.plain_name(F.concat("text", F.lit(" Jr."))).alias("name"))


@query("fn4_fuzzy_name", "SELECT count(*) FILTER (abs(length(x) - length(y)) <= 2 AND levenshtein(x, y) <= 2 OR contains(x, y) OR contains(y, x)) AS n FROM (SELECT lower(c_name) AS x, lower('Customer#' || lpad(CAST(c_custkey + c_custkey % 200 AS VARCHAR), 9, '0')) AS y FROM customer)")
def fn4(spark, folder):
    other = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + F.col("c_custkey") % 200).cast("string"), 9, "0"))
    return table(spark, folder, "customer").agg(F.count_if(T.fuzzy_name(F.col("c_name"), other)).alias("n"))


@query("fn5_name_match", "SELECT p_partkey, x = y OR split_part(x, ' ', -1) = split_part(y, ' ', -1) OR contains(x, y) OR contains(y, x) AS same FROM (SELECT p_partkey, lower(p_name) AS x, CASE WHEN p_partkey % 2 = 0 THEN 'red bolt' ELSE 'ring' END AS y FROM part)")
def fn5(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.same_name(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "red bolt").otherwise("ring")).alias("same"))


@query("fn7_slug", "SELECT s_suppkey, regexp_replace(regexp_replace(trim(regexp_replace(lower(s_name || ' of  Place'), '[^a-z0-9 -]', '', 'g')), '[ ]+', '-', 'g'), '-+', '-', 'g') AS slug FROM supplier")
def fn7(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", T.slug(F.concat("s_name", F.lit(" of  Place"))).alias("slug"))


@query("fn8_event_score", "SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'red') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), 'bolt') THEN 3 ELSE 0 END)::INT AS score FROM part")
def fn8(spark, folder):
    return table(spark, folder, "part").select("p_partkey", T.event_score(F.col("p_name"), "the red vs bolt").alias("score"))


@query("fn9_fn10_measures", "SELECT p_partkey, round(((p_size // 12) * 12 + p_size % 12) * 2.54, 6) AS height, round(CASE WHEN p_size * 3 > 100 THEN p_size * 3 ELSE p_size * 3 * 2.54 END, 6)::DOUBLE AS reach, p_size::DOUBLE AS weight FROM part")
def fn9(spark, folder):
    s = F.col("p_size")
    height = F.concat(F.floor(s / 12).cast("string"), F.lit("' "), (s % 12).cast("string"), F.lit('"'))
    return table(spark, folder, "part").select("p_partkey", r6(T.height_cm(height)).alias("height"), r6(T.reach_cm(F.concat((s * 3).cast("string"), F.lit('"')))).alias("reach"), T.pounds(F.concat(s.cast("string"), F.lit(" lbs."))).alias("weight"))


@query("fn12_fn13_percent_record", "SELECT p_partkey, p_size::DOUBLE AS percent, p_size AS wins, (p_size % 7)::INT AS losses, (p_size % 3)::INT AS draws FROM part")
def fn12(spark, folder):
    s = F.col("p_size")
    record = F.concat_ws("-", s, s % 7, s % 3)
    return table(spark, folder, "part").select("p_partkey", T.percent(F.concat(s.cast("string"), F.lit("% "))).alias("percent"), *(T.record(record, i).alias(n) for i, n in ((1, "wins"), (2, "losses"), (3, "draws"))))


@query("fn14_fn15_result_method", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'nc' END AS result, CASE left(o_orderpriority, 1) WHEN '1' THEN 'KO' WHEN '2' THEN 'SUB' WHEN '3' THEN 'DEC' ELSE 'OTHER' END AS method FROM orders")
def fn14(spark, folder):
    text = F.when(F.col("o_orderstatus") == "F", " WIN ").when(F.col("o_orderstatus") == "O", "Loss").otherwise("No Contest")
    k = F.left("o_orderpriority", F.lit(1))
    how = F.when(k == "1", "ko/tko punch").when(k == "2", "submission").when(k == "3", "u-dec").otherwise("dq")
    return table(spark, folder, "orders").select("o_orderkey", T.result(text).alias("result"), T.method(how).alias("method"))


@query("fn16_normalised_class", "SELECT DISTINCT c_mktsegment, lower(trim(regexp_replace(c_mktsegment || ' Division', ' Division$', ''))) AS class FROM customer")
def fn16(spark, folder):
    x = F.concat("c_mktsegment", F.lit(" Division"))
    return table(spark, folder, "customer").select("c_mktsegment", F.lower(F.trim(F.regexp_replace(x, " Division$", ""))).alias("class")).distinct()


@query("fn17_clean_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, TRY_CAST(regexp_extract(text, '(\\d+)', 1) AS INT) AS number FROM documents")
def fn17(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.squeezed(F.col("text")).alias("clean"), F.regexp_extract("text", r"(\d+)", 1).try_cast("int").alias("number"))


@query("fn19_year_in_text", "SELECT o_orderkey, regexp_extract('on ' || strftime(o_orderdate, '%d.%m.%Y'), '((?:19|20)\\d\\d)', 1)::INT AS year FROM orders")
def fn19(spark, folder):
    x = F.concat(F.lit("on "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    return table(spark, folder, "orders").select("o_orderkey", F.regexp_extract(x, r"((?:19|20)\d\d)", 1).cast("int").alias("year"))


@query("fn20_many_date_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders")
def fn20(spark, folder):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "MMM dd, yyyy")).otherwise("TBD")
    return table(spark, folder, "orders").select("o_orderkey", T.parse_date(text).alias("d"))


@query("fn21_fn22_ages", "SELECT o_orderkey, date_sub('year', o_orderdate::DATE, DATE '2020-06-15')::INT AS years, date_diff('day', o_orderdate::DATE, DATE '2020-06-15') AS days FROM orders")
def fn21(spark, folder):
    asof = F.lit("2020-06-15").cast("date")
    return table(spark, folder, "orders").select("o_orderkey", T.age_years(F.to_date("o_orderdate"), asof).alias("years"), F.datediff(asof, "o_orderdate").cast("long").alias("days"))


@query("fn23_clock", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0.5, CASE WHEN l_quantity < 10 THEN l_linenumber * 5 WHEN l_quantity > 45 THEN 15 ELSE (l_linenumber - 1) * 5 + l_quantity::INT // 10 + (l_quantity::INT % 10) / 60 END), 6) AS minutes FROM lineitem")
def fn23(spark, folder):
    q = F.col("l_quantity").cast("int")
    clock = F.when(q >= 10, F.concat(F.floor(q / 10).cast("string"), F.lit(":0"), (q % 10).cast("string")))
    round_ = F.when(q <= 45, F.col("l_linenumber"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(T.clock_minutes(round_, clock)).alias("minutes"))


@query("fn25_keywords_in_context", "SELECT doc_id, len(regexp_extract_all(lower(text), '(?s).{0,20}license.{0,20}')) AS n, regexp_extract(lower(text), '(?s).{0,20}license.{0,20}') AS first FROM documents WHERE contains(lower(text), 'license')")
def fn25(spark, folder):
    hits = T.in_context(F.col("text"), "license", 20)
    return table(spark, folder, "documents").filter(F.lower("text").contains("license")).select("doc_id", F.size(hits).cast("long").alias("n"), hits[0].alias("first"))


@query("fn26_odds", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN q > 0 THEN 1 + q / 100.0::DOUBLE WHEN q < 0 THEN 1 + 100.0::DOUBLE / abs(q) END, 6) AS decimal, round(1 / CASE WHEN q > 0 THEN 1 + q / 100.0::DOUBLE WHEN q < 0 THEN 1 + 100.0::DOUBLE / abs(q) END, 6) AS implied FROM (SELECT *, (l_quantity::INT - 25) * 10 AS q FROM lineitem)")
def fn26(spark, folder):
    q = (F.col("l_quantity").cast("int") - 25) * 10
    decimal = MK.parse_american(F.when(q > 0, F.concat(F.lit("+"), q.cast("string"))).otherwise(q.cast("string")))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(decimal).alias("decimal"), r6(MK.implied(decimal)).alias("implied"))


@query("fn27_probability_to_american", "SELECT o_orderkey, CASE WHEN p > 0 AND p < 1 THEN round_even(CASE WHEN q >= 0.5 THEN -100 * q / (1 - q) ELSE 100 * (1 - q) / q END, 0)::INT END AS american FROM (SELECT *, greatest(0.01, least(0.99, p)) AS q FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS p FROM orders))")
def fn27(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", MK.probability_to_american((F.col("o_orderkey") % 101) / 100.0).alias("american"))


@query("fn28_vig", "SELECT p_partkey, round(greatest(0.04, least(0.96, x * 1.0225)), 6) AS a, round(greatest(0.04, least(0.96, (1 - x) * 1.0225)), 6) AS b FROM (SELECT p_partkey, p_size / 51.0::DOUBLE AS x FROM part)")
def fn28(spark, folder):
    a, b = MK.with_vig(F.col("p_size") / 51.0)
    return table(spark, folder, "part").select("p_partkey", r6(a).alias("a"), r6(b).alias("b"))


@query("fn29_expectation", "SELECT s_suppkey, round(1 / (1 + pow(10, (1500 - r) / 400)), 6) AS e, round(CASE WHEN r - 1500 > 800 THEN 0.99 WHEN r - 1500 < -800 THEN 0.01 ELSE 1 / (1 + pow(10, -(r - 1500) / 400)) END, 6) AS saturated FROM (SELECT s_suppkey, 1500 + s_acctbal / 5 AS r FROM supplier)")
def fn29(spark, folder):
    r = 1500 + F.col("s_acctbal") / 5
    return table(spark, folder, "supplier").select("s_suppkey", r6(R.expected(r, F.lit(1500.0))).alias("e"), r6(R.expected_saturating(r - 1500)).alias("saturated"))


@query("fn30_tempered", "SELECT o_orderkey, round(greatest(0.10, least(0.90, 1 / (1 + exp(-ln(p / (1 - p)) / 0.62)))), 6) AS p FROM (SELECT o_orderkey, 0.50 + (o_orderkey % 45) / 100.0::DOUBLE AS p FROM orders)")
def fn30(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", r6(MK.tempered(0.50 + (F.col("o_orderkey") % 45) / 100.0)).alias("p"))


@query("fn31_expected_value", "SELECT l_orderkey, l_linenumber, l_partkey, round((0.5 + l_discount) * (1.5 + l_tax - 1) - (1 - (0.5 + l_discount)), 6) AS ev FROM lineitem")
def fn31(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(MK.expected_value(0.5 + F.col("l_discount"), 1.5 + F.col("l_tax"))).alias("ev"))


@query("fn32_fn33_arithmetic", "SELECT c_custkey, round(sign(x) * x * x, 4)::DOUBLE AS squared, round(ln(abs(x) + 1), 6) AS logged, round(x - CASE WHEN c_custkey % 2 = 0 THEN 1.5 END, 2) AS diff FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def fn32(spark, folder):
    x = F.col("c_acctbal") / 1000
    return table(spark, folder, "customer").select("c_custkey", F.round(F.signum(x) * x * x, 4).alias("squared"), r6(F.ln(F.abs(x) + 1)).alias("logged"), F.round(x - F.when(F.col("c_custkey") % 2 == 0, 1.5), 2).alias("diff"))


@query("fn35_truncation", "SELECT c_custkey, trunc(c_acctbal)::INT AS n FROM customer")
def fn35(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").cast("int").alias("n"))


@query("fn36_fn37_null_functions", "SELECT c_custkey, least(c_acctbal, CASE WHEN c_nationkey > 9 THEN 100 END, 5000)::DOUBLE AS lo, greatest(c_acctbal, CASE WHEN c_nationkey > 9 THEN 100 END)::DOUBLE AS hi, coalesce(nullif(c_nationkey, 0), nullif(c_nationkey % 5, 0), -1) AS first, replace(lower(c_mktsegment), 'u', 'v') AS text FROM customer")
def fn36(spark, folder):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    some = F.when(n > 9, 100.0)
    return table(spark, folder, "customer").select("c_custkey", F.least(b, some, F.lit(5000.0)).alias("lo"), F.greatest(b, some).alias("hi"), F.coalesce(F.nullif(n, F.lit(0)), F.nullif(n % 5, F.lit(0)), F.lit(-1)).alias("first"), F.replace(F.lower("c_mktsegment"), F.lit("u"), F.lit("v")).alias("text"))


@query("fn38_json_fields", "SELECT event_id, coalesce(json_extract_string(props, '$.penalty'), json_extract_string(props, '$.k'))::INT AS k FROM events")
def fn38(spark, folder):
    return table(spark, folder, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.penalty"), F.get_json_object("props", "$.k")).cast("int").alias("k"))


@query("fn39_arrays", "SELECT o_custkey, max(o_totalprice) AS hi, arg_max(o_totalprice, o_orderkey) AS last, sum(o_totalprice) FILTER (n <= 3) AS first3, max((o_totalprice > 300000)::INT) = 1 AS any_big FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1")
def fn39(spark, folder):
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    v = F.transform("a", lambda x: x["o_totalprice"])
    first3 = F.aggregate(F.slice(v, 1, 3), F.lit(0.0), lambda s, x: s + x)
    return rows.select("o_custkey", F.array_max(v).alias("hi"), F.element_at(v, -1).alias("last"), F.round(first3, 2).alias("first3"), F.exists(v, lambda x: x > 300000).alias("any_big"))


M.SQL["fn39_arrays"] = M.SQL["fn39_arrays"].replace("sum(o_totalprice) FILTER (n <= 3) AS", "round(sum(o_totalprice) FILTER (n <= 3), 2) AS")
