"""Clustering with Elkan's bounds against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from ringledger.llm import centroids


def plain(rows, k, rounds, scale=256, seed="2"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"{seed}:{kept[r][0]}".encode()).hexdigest(), np.array(kept[r][1]).tobytes()))
    now = [list(kept[r][1]) for r in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [min(range(len(now)), key=lambda c: (dist(v, now[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(now)):
                mine = [kept[r][1] for r in range(len(kept)) if own[r] == c]
                if mine:
                    now[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    d = [dist(v, now[c]) for (_, v), c in zip(kept, own, strict=True)]
    by = {c: sum(x for x, o in zip(d, own, strict=True) if o == c) for c in set(own)}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted((i, c, x, by[c], sum(d), name[c]) for (i, _), c, x in zip(kept, own, d, strict=True))


def found(df):
    return sorted(tuple(r) for r in centroids.centroid_names(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("grid", [True, False])
def test_equals_plain_integers(spark, grid):
    r = random.Random(4)
    value = (lambda: r.randrange(-2, 3) / 256) if grid else (lambda: r.gauss(0, 1))  # the grid is full of ties
    rows = [(i, [value() for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, list(rows[5][1])) for i in range(150)]  # a common vector
    for k in (1, 7, 40):
        assert found(centroids.cluster(frame(spark, rows), k=k, rounds=5, size=8)) == plain(rows, k, 5)


def test_rows_that_are_left_out(spark):
    good = [(i, [i / 7.0, -i / 3.0]) for i in range(5)]
    bad = [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (56, [1.0, 2.0, 3.0])]
    assert found(centroids.cluster(frame(spark, good + bad), k=40, rounds=5, size=2)) == plain(good, 40, 5)
    assert found(centroids.cluster(frame(spark, bad), size=2)) == []
    nameless = centroids.cluster(frame(spark, good + [(None, [0.5, 0.5])]), k=6, size=2).filter("vec_id is null").collect()
    assert [r["cluster"] for r in nameless] == [5]


def test_values_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(frame(spark, [(1, [1e30, 0.0])]), size=2)


def test_bounds_hold_and_save_distances(monkeypatch):
    r = np.random.default_rng(1)
    centre = r.integers(-500, 500, (12, 16))
    v = (centre[r.integers(0, 12, 3000)] + r.integers(-40, 40, (3000, 16))).astype(np.int64)
    now = v[:12].copy()
    state = centroids.Step(now, None).first(v)
    done = []
    real = centroids.squared
    for _ in range(6):
        before = now
        now = np.array([v[state[0] == c].sum(axis=0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else before[c] for c in range(12)])
        step = centroids.Step(now, before)
        count = [0]
        monkeypatch.setattr(centroids, "squared", lambda x, y, n=count: (n.__setitem__(0, n[0] + len(x)), real(x, y))[1])
        state = step.again(v, *state)
        monkeypatch.setattr(centroids, "squared", real)
        done.append(count[0])
        each = np.stack([real(v, c) for c in now], axis=1)
        assert (state[0] == each.argmin(axis=1)).all()
        assert (state[1] ** 2 >= each[np.arange(len(v)), state[0]]).all()
        assert (state[2] ** 2 <= each).all()
    assert done[-1] < 3000 * 12 / 4
