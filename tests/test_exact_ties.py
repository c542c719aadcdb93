"""Means and edges that stand on a limit, against fractions."""

import random
from fractions import Fraction
from math import floor

from pyspark.sql import functions as F

from ringledger.functions import numbers
from ringledger.operators import stats


def test_mean_to_four_decimals(spark):
    r = random.Random(6)
    rows = [(r.randrange(-(10**12), 10**12) * 500, r.choice([1, 2, 3, 4, 7, 8, 64])) for _ in range(500)] + [(0, 0), (15000005000, 2)]
    df = spark.createDataFrame(rows, "t long, n long")
    got = {(x["t"], x["n"]): x["m"] for x in df.select("t", "n", numbers.mean4(F.col("t").cast("decimal(20,0)"), F.col("n")).alias("m")).collect()}
    for t, n in rows:
        half_up = lambda x: floor(abs(x) + Fraction(1, 2)) * (1 if x >= 0 else -1)
        assert got[t, n] == (None if n == 0 else half_up(Fraction(t, 1000 * n)) / 10000), (t, n)


def test_edges_on_the_limits(spark):
    r = random.Random(7)
    rows = [(n, k, 100 * k - e) for n in (9, 10, 20, 25, 100, 400) for k in (0, 1, n // 2, n - 1, n) for e in (0, 3 * n, -3 * n, 3 * n - 1, 3 * n + 1, 196, 490, r.randrange(-5000, 5000))]
    rows += [(100, 50, 5000 - 980), (100, 50, 5000 - 979)]  # 1.96 * sqrt(0.25 / 100) is 0.098 exactly
    df = spark.createDataFrame(rows, "n long, k long, e long").withColumn("x", stats.edge_warnings(F.col("n"), F.col("k"), F.col("e")))
    for row in df.collect():
        n, k, edge = row["n"], row["k"], Fraction(100 * row["k"] - row["e"], 100 * row["n"])
        rate = Fraction(k, n)
        low = edge < 0 or edge * edge < Fraction(196, 100) ** 2 * rate * (1 - rate) / n
        want = (n < 20) + (abs(edge) < Fraction(3, 100)) + low
        assert row["x"]["warnings"] == (want if n >= 10 else None), row
