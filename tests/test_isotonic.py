"""Isotonic regression in levels against the minimax formula and against one fit over all points."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression

from ringledger.operators import isotonic


def plain(points):
    """The rate of each distinct score: the highest, over starts, of the lowest mean over ends."""
    by = {}
    for p, y in points:
        if p is not None and y is not None:
            n, s = by.get(p, (0, 0.0))
            by[p] = (n + 1, s + y)
    xs = sorted(by)
    n, s = [by[x][0] for x in xs], [by[x][1] for x in xs]
    mean = lambda a, b: sum(s[a : b + 1]) / sum(n[a : b + 1])
    return {xs[i]: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))}


def points(seed, n=150):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        p = round(r.random(), 2)
        out.append((p, float(r.random() < 0.2 + 0.6 * p)))
    return out + [(0.5, 1.0)] * 60 + [(None, 1.0), (0.3, None)]  # a common score


@pytest.mark.parametrize("rows,fan", [(7, 2), (20, 3), (200_000, 32)])
def test_levels_equal_the_formula(spark, rows, fan):
    for seed in (1, 2):
        data = points(seed)
        df = spark.createDataFrame(data, "p double, label double").repartition(4)
        found = isotonic.blocks(df, rows=rows, fan=fan).orderBy("lo").collect()
        want = plain(data)
        got = {x: next(b["s"] / b["n"] for b in found if b["lo"] <= x <= b["hi"]) for x in want}
        assert got == pytest.approx(want)
        rates = [b["s"] / b["n"] for b in found]
        assert rates == sorted(set(rates)) and sum(b["n"] for b in found) == len(data) - 2


def test_calibrator_equals_one_fit_over_all(spark):
    data = [x for x in points(3) if None not in x]
    df = spark.createDataFrame(data, "p double, label double")
    ours = isotonic.Calibrator.fit(df, rows=20, fan=2)
    asked = spark.createDataFrame([(x / 97,) for x in range(-5, 105)], "p double")
    one = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="q").fit(df).transform(asked)
    got = one.withColumn("mine", ours(one["p"])).collect()
    assert [r["mine"] for r in got] == pytest.approx([r["q"] for r in got])
    held = asked.withColumn("q", ours(asked["p"], 0.4, 0.5)).selectExpr("min(q)", "max(q)").first()
    assert tuple(held) == (0.4, 0.5)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(None, 1.0)], "p double, label double")
    fit = isotonic.Calibrator.fit(none)
    assert none.select(fit(none["p"]).alias("q")).first()["q"] is None
    some = isotonic.Calibrator.fit(spark.createDataFrame([(0.5, 1.0)], "p double, label double"))
    asked = spark.createDataFrame([(0.1,), (None,)], "p double")
    assert [r["q"] for r in asked.select(some(asked["p"]).alias("q")).collect()] == [1.0, None]
