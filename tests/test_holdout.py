"""All measures of a holdout evaluation against plain Python, and their intervals."""

import random

import numpy as np
import pytest

from ringledger.operators import holdout


def contests(n=1500):
    r = random.Random(4)
    out = []
    for i in range(n):
        p = round(r.random(), 2)
        out.append((i, p, r.random() < p, r.choice((0, 1, 2, 2))))
    return out


def brute(rows):
    p, y, right = (np.array([float(x[k]) for x in rows]) for k in (1, 2, 3))
    won, lost = p[y == 1], p[y == 0]
    got = {"auc": (len(p), ((won[:, None] > lost) + (won[:, None] == lost) / 2).mean()), "accuracy": (len(p), ((p > 0.5) == (y == 1)).mean()), "row_accuracy": (len(p), right.mean() / 2)}
    got |= {"brier": (len(p), ((p - y) ** 2).mean()), "log_loss": (len(p), -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-15, 1)).mean())}
    profit = [0.91 if (a >= 0.574) == (b == 1) else -1.0 for a, b in zip(p, y, strict=True) if a >= 0.574 or 1 - a >= 0.574]
    got["roi"] = (len(profit), np.mean(profit))
    for a, b in ((0.5, 0.55), (0.55, 0.6), (0.6, 0.65), (0.65, 0.7), (0.7, 1.0)):
        m = (p >= a) & (p < b)
        got[f"gap, {a:.2f} to {b:.2f}"] = (m.sum(), (y[m] - p[m]).mean())
    return got


def test_all_measures_with_intervals(spark, monkeypatch):
    monkeypatch.setattr(holdout, "RANGE", 30)  # four ranges
    rows = contests()
    df = spark.createDataFrame(rows, "id long, p double, won boolean, right int")
    got = {r["measure"]: r for r in holdout.intervals(df, 1000).collect()}
    want = brute(rows)
    assert set(got) == set(want) and len(got) == 11
    chance, drawn = np.random.default_rng(1), {m: [] for m in want}
    for _ in range(200):
        for m, (_, v) in brute([rows[i] for i in chance.integers(0, len(rows), len(rows))]).items():
            drawn[m].append(v)
    for m, (n, value) in want.items():
        assert got[m]["n"] == n and got[m]["value"] == pytest.approx(value, abs=1e-12)
        assert got[m]["lo"] < value < got[m]["hi"]
        lo, hi = np.percentile(drawn[m], (2.5, 97.5))
        assert got[m]["hi"] - got[m]["lo"] == pytest.approx(hi - lo, rel=0.3)


def test_intervals_do_not_depend_on_ranges(spark, monkeypatch):
    df = spark.createDataFrame(contests(300), "id long, p double, won boolean, right int")
    first = {r["measure"]: tuple(r)[1:] for r in holdout.intervals(df, 50).collect()}
    monkeypatch.setattr(holdout, "RANGE", 7)
    monkeypatch.setattr(holdout, "CHUNK", 3)
    for r in holdout.intervals(df.repartition(5), 50).collect():
        assert tuple(r)[1:] == pytest.approx(first[r["measure"]], abs=1e-9)


def test_one_outcome_has_no_area(spark):
    got = {r["measure"]: r for r in holdout.intervals(spark.createDataFrame([(1, 0.4, True, 0), (2, 0.6, True, 2)], "id long, p double, won boolean, right int"), 20).collect()}
    assert got["auc"]["value"] is None and got["accuracy"]["value"] == 0.5 and got["gap, 0.70 to 1.00"]["n"] == 0


def test_query_has_all_measures(spark):
    from ringledger.plans import registry

    rows = registry.queries()["dm32_holdout_intervals"](spark, "/root/testdata/sf0.001").collect()
    assert {r["measure"] for r in rows} == {"auc", *holdout.SUMS}
