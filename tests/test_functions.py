"""Scalar vectors and differential tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringledger import api
from ringledger.functions import markets as MK
from ringledger.functions import ratings as R
from ringledger.functions import text as T
from ringledger.operators import asof, keyed, metrics, rating, stats
from ringledger.operators import history as H


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("days", "r", "want"), [(100, 1600, 0), (180, 1600, 0), (270, 1500, 10), (450, 1500, 20), (630, 1500, 30), (900, 1500, 40), (365, 1400, 10), (181, 1600, 13)])
def test_inactivity(spark, days, r, want):
    assert value(spark, R.inactivity_penalty(F.lit(days), F.lit(float(r)))) == want


@pytest.mark.parametrize(("odds", "want"), [(-200, 1.5), (200, 3.0), (100, 2.0), (-100, 2.0), (0, None), (-150, 1 + 100 / 150)])
def test_american(spark, odds, want):
    assert value(spark, MK.american_to_decimal(F.lit(odds))) == (want if want is None else pytest.approx(want))


def test_round_trip_of_odds(spark):
    p = R.expected(F.lit(1550.0), F.lit(1450.0))
    assert 0.55 < value(spark, p) < 0.75 and value(spark, MK.probability_to_american(p)) < 0
    back = value(spark, MK.implied(MK.american_to_decimal(MK.probability_to_american(p))))
    assert back == pytest.approx(value(spark, p), abs=0.02)
    a, b = MK.with_vig(R.expected_saturating(F.lit(200.0)))
    assert value(spark, a) + value(spark, b) > 1


def test_texts(spark):
    assert value(spark, T.height_cm(F.lit("5' 11\""))) == pytest.approx(71 * 2.54)
    assert value(spark, T.reach_cm(F.lit('72"'))) == pytest.approx(72 * 2.54) and value(spark, T.reach_cm(F.lit("180"))) == 180
    assert value(spark, T.clock_minutes(F.lit(2), F.lit("2:30"))) == 7.5 and value(spark, T.clock_minutes(F.lit(None).cast("int"), F.lit("2:30"))) == 15
    assert value(spark, T.plain_name(F.lit(" José  Álvarez Jr. "))) == "jose alvarez"
    assert value(spark, T.parse_date(F.lit("Jan 05, 2020"))) == dt.date(2020, 1, 5)
    assert value(spark, T.visible_text(F.lit("<nav>x</nav><p>A <b>B</b></p><script>y</script>"))) == "a b"


def test_features_do_not_see_later_rows(spark):
    rows = [(e, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i, ("win", "loss", "draw")[(i * e) % 3], ("KO", "DEC")[i % 2], float(i * e)) for e in (1, 2) for i in range(12)]
    df = spark.createDataFrame(rows, "entity long, d timestamp, id long, result string, method string, value double")
    whole = {(r["entity"], r["id"]): r for r in H.features(df).collect()}
    part = H.features(df.filter("id < 7")).collect()
    assert len(part) == 14 and all(whole[r["entity"], r["id"]] == r for r in part)
    assert api.audit(df).first()["mismatches"] == 0


def test_rating_is_zero_sum(spark):
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=30 * i), i % 3, 3 + i % 2, i % 3 if i % 4 else None) for i in range(20)]
    h = rating.rate(spark.createDataFrame(rows, "id long, d timestamp, a long, b long, winner long"))
    assert h.count() == 40
    assert h.groupBy("id").agg(F.abs(F.sum("change")).alias("x")).filter("x > 1e-9").count() == 0
    assert {r["result"] for r in h.collect()} == {"win", "loss", "draw"}


def test_asof(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 1, "z"), (None, 1, "n")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 3, 10, 1), (1, 3, 11, 2), (1, 5, 12, 3), (2, 2, 13, 4)], "k long, t long, v long, i long")
    strict = {r["name"]: r["asof_v"] for r in asof.asof(left, right, "k", "t", ["v"], "i").collect()}
    assert strict == {"x": 11, "y": None, "z": None, "n": None}
    loose = {r["name"]: r["asof_v"] for r in asof.asof(left, right, "k", "t", ["v"], "i", strict=False).collect()}
    assert loose == {"x": 12, "y": 11, "z": None, "n": None}


def test_keyed(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", 2), (None, "n", 3)], "k long, x string, y long")
    delta = spark.createDataFrame([(2, "B", None), (3, "c", 4), (None, "m", 5)], "k long, x string, y long")
    assert {(r["k"], r["x"]) for r in keyed.upsert(base, delta, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c"), (None, "m")}
    filled = keyed.fill_only(base, spark.createDataFrame([(1, 9), (2, 9)], "k long, y long"), ["k"], ["y"])
    assert {(r["k"], r["y"]) for r in filled.collect()} == {(1, 9), (2, 2), (None, 3)}


def test_metrics_and_stats(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.1, 1)], "p double, y int")
    assert metrics.auc(df).first()["auc"] == pytest.approx((2 + 1.5 + 0) / 6)
    tail = value(spark, stats.binomial_tail(F.lit(8), F.lit(10), F.lit(0.5)))
    assert tail == pytest.approx(56 / 1024)
    few = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.04), ("d", 0.3)], "name string, p_value double")
    got = {r["name"]: (r["bonferroni"], r["holm"]) for r in stats.corrected(few).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, False), "d": (False, False)}
    assert value(spark, MK.kelly(F.lit(0.02), F.lit(2.0))) == 0 and value(spark, MK.kelly(F.lit(0.5), F.lit(2.0))) == 0.05


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, d timestamp, a long, b long, winner long")
    assert api.rate(none).count() == 0 and api.resolve(none, none).count() == 0
    h = spark.createDataFrame([], "entity long, d timestamp, id long, result string, method string, value double")
    assert H.features(h).count() == 0 and H.point_in_time(h).count() == 0
