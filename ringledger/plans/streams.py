"""Streams and user-defined functions as queries (STR, UD)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ringledger.operators import keyed
from ringledger.plans.base import Module, history, r6
from ringledger.sources.tables import table
from ringledger.streaming import replay

M = Module()
query = M.query


@query("str2_distinct_within_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def str2(spark, folder):
    return replay.run(replay.distinct_within(replay.events(spark, folder), ["user_id", "event_type"], "60 days")).select("user_id", "event_type")


@query("str3_one_hour_rule", "SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p > INTERVAL 1 HOUR")
def str3(spark, folder):
    return replay.run(replay.suppressed(replay.events(spark, folder)))


@query("str5_incremental_rating", "SELECT user_id, round(list_reduce(list((event_type = 'purchase')::INT::DOUBLE ORDER BY ts, event_id), lambda r, x: r + 32 * (x - 1 / (1 + pow(10, (1500 - r) / 400))), 1500.0::DOUBLE), 6) AS rating, count(*) AS n FROM events GROUP BY 1")
def str5(spark, folder):
    rated = replay.run(replay.ratings(replay.events(spark, folder)))
    return rated.groupBy("user_id").agg(r6(F.max_by("rating", "n")).alias("rating"), F.max("n").alias("n"))


@query("str6_upsert_by_batch", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def str6(spark, folder):
    def merge(old, batch):
        new = keyed.first_per_key(batch.select("user_id", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
        return new if old is None else keyed.upsert(old, new, ["user_id"])

    return replay.upsert_batches(replay.events(spark, folder, per_trigger=1), merge).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query("str_addition_tumbling")
def tumbling(spark, folder):
    """Windows that the watermark has closed when the stored stream ends."""
    return replay.run(replay.tumbling(replay.events(spark, folder)))


@query("str_addition_tumbling_batch", "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_batch(spark, folder):
    """The same aggregation over the whole table, without a watermark."""
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query("str_addition_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, folder):
    e = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("ud1_scalar_function", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders")
def ud1(spark, folder):
    """A scalar pandas function over Arrow batches, where an expression would do as well."""

    @F.pandas_udf(DoubleType())
    def root(x: pd.Series) -> pd.Series:
        return x**0.5

    return table(spark, folder, "orders").select("o_orderkey", r6(root("o_totalprice")).alias("root"))


@query("ud3_group_function", "SELECT o_custkey AS entity, round(median(o_totalprice), 6) AS mid FROM orders GROUP BY 1")
def ud3(spark, folder):
    """A function of a group as an aggregate pandas function: a group streams in as one series."""

    @F.pandas_udf(DoubleType())
    def middle(x: pd.Series) -> float:
        return float(x.median())

    return history(spark, folder).groupBy("entity").agg(r6(middle("value")).alias("mid"))


@query("ud6_table_function", "SELECT page_id, 'title' AS kind, regexp_extract(html, '<title>([^<]*)</title>', 1) AS value FROM pages WHERE regexp_matches(html, '<title>[^<]*</title>') UNION ALL SELECT page_id, 'link', unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) FROM pages")
def ud6(spark, folder):
    """A table function: one page in, rows of several kinds out."""

    class Extract:
        def eval(self, html: str):
            for kind, pattern in (("title", r"<title>([^<]*)</title>"), ("link", r'href="([^"]*)"')):
                for n, value in enumerate(re.findall(pattern, html or "")):
                    if kind != "title" or n == 0:
                        yield kind, value

    schema = StructType([StructField("kind", StringType()), StructField("value", StringType())])
    extract = F.udtf(Extract, returnType=schema)
    spark.udtf.register("extract_rows", extract)
    return spark.sql("SELECT page_id, x.kind, x.value FROM {pages} p, LATERAL extract_rows(p.html) x", pages=table(spark, folder, "pages"))
