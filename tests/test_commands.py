"""Commands from end to end: train, card, names, log, weekly run, edges; Holm's correction; upserts that go on after a restart."""

import random

from pyspark.sql import functions as F

from ringledger import api
from ringledger.operators import keyed, stages, stats
from ringledger.sources.bucketed import BucketedTable
from ringledger.sources.files import scratch
from ringledger.streaming import replay
from test_modeling import contest_rows


def test_train_then_card(spark, monkeypatch):
    monkeypatch.setattr(api.ensemble, "forest", lambda real=api.ensemble.forest: real(6, 3))
    contests = contest_rows(spark, 150)
    ratings = spark.createDataFrame([(e, 1500.0 + 10 * e) for e in range(12)], "entity long, rating double")
    home = scratch(spark)
    version = api.train_model(spark, home, contests, ratings)
    upcoming = spark.createDataFrame([(1000, 0, 11), (1001, 5, 99)], "id long, a long, b long").withColumn("d", F.expr("timestamp_ntz '2022-01-01'"))
    odds = spark.createDataFrame([(1000, 5.0, 1.01)], "id long, decimal_a double, decimal_b double")
    got = {r["id"]: r for r in api.predict_card(spark, home, upcoming, contests, ratings, odds=odds).collect()}
    assert set(got) == {1000, 1001} and all(0.1 <= r["p"] <= 0.9 and r["model_p"] is not None for r in got.values())
    assert got[1001]["bet_on"] is None and version.startswith("v3_")


def test_names_and_log(spark):
    known = spark.createDataFrame([(1, "José Aldó"), (2, "Max Holloway")], "k long, name string")
    asked = spark.createDataFrame([(7, "jose aldo"), (8, "Mx Holloweay"), (9, "nobody else")], "a long, name string")
    assert {r["a"]: (r["tier"], r["k"]) for r in api.find_names(asked, known, "a", "k").collect()} == {7: (1, 1), 8: (3, 2), 9: (None, None)}
    contests = contest_rows(spark, 40)
    log = contests.limit(10).select("a", "b", "d", F.lit(None).cast("long").alias("winner")).unionByName(spark.createDataFrame([(77, 78)], "a long, b long").select("a", "b", F.expr("timestamp_ntz '2022-01-01'").alias("d"), F.lit(None).cast("long").alias("winner")))
    folder = scratch(spark)
    table = BucketedTable.create(log, folder, ["a", "b", "d"], 4)
    assert api.update_log(spark, folder, log, contests)
    now = table.read()
    assert now.filter("winner is null").count() == 1 and now.count() == log.select("a", "b", "d").distinct().count()


def test_weekly_and_edges(spark):
    plan = [stages.Stage("load", 1, lambda t: t["s"]), stages.Stage("rate", 2, lambda t: t["s"].limit(1))]
    home, src = scratch(spark), {"s": spark.range(3)}
    assert [r["state"] for r in api.weekly(spark, home, plan, src, skip=["rate"]).orderBy("priority").collect()] == ["done"]
    assert [r["state"] for r in api.weekly(spark, home, plan, src).orderBy("priority").collect()] == ["kept", "done"]
    e = api.edges(spark.createDataFrame([(400, 280, 0.5), (20, 15, 0.5)], "n int, won int, expected double")).orderBy("n").collect()
    assert [(r["valid"], r["usable"]) for r in e] == [(False, False), (True, True)]


def test_holm_equals_the_procedure(spark):
    r = random.Random(4)
    for case in range(4):
        ps = [r.choice([0.0001, 0.001, 0.004, 0.01, 0.02, 0.3, r.random() / 50]) for _ in range(12)] + [None] * (case % 2)
        rows = sorted(enumerate(ps), key=lambda x: (x[1] is not None, x[1] or 0))
        n, ok, want = len(ps), True, {}
        for i, (k, p) in enumerate(rows):
            if p is not None:
                ok = ok and p < 0.05 / (n - i)
                want[k] = (p < 0.05 / n, ok)
            else:
                want[k] = (None, None)
        got = stats.corrected(spark.createDataFrame(list(enumerate(ps)), "name int, p_value double"))
        assert {x["name"]: (x["bonferroni"], x["holm"]) for x in got.collect()} == want


def test_upserts_go_on_after_a_restart(spark):
    home, base, state = scratch(spark), scratch(spark), scratch(spark)

    def arrive(rows):
        spark.createDataFrame(rows, "k long, v long").coalesce(1).write.mode("append").parquet(home)

    def go():
        stream = spark.readStream.schema("k long, v long").parquet(home)
        done = replay.upsert_batches(stream, lambda old, new: new if old is None else keyed.upsert(old, new, ["k"]), base, state)
        return sorted(tuple(r) for r in done.collect())

    arrive([(1, 1), (2, 1)])
    assert go() == [(1, 1), (2, 1)]
    arrive([(2, 2), (3, 2)])
    assert go() == [(1, 1), (2, 2), (3, 2)]
