"""Sequential ratings beside a loop of their own, plain and enhanced, on contests that fall apart into components."""

import datetime
import random

import pyarrow as pa

from ringledger.operators import graph, rating


def contests(n=160):
    r = random.Random(5)
    day = datetime.datetime(2020, 1, 1)
    out = []
    for i in range(n):
        group = r.randrange(3) * 100
        a, b = r.sample(range(group, group + 9), 2)
        winner = r.choice([a, b, None])
        out.append((i, day + datetime.timedelta(days=r.randrange(900)), a, b, winner, r.choice(["title", "main", "regular"]), r.uniform(-0.1, 0.1), r.uniform(-0.1, 0.1)))
    return out


def loop(rows, enhanced):
    elo, last, past, out = {}, {}, {}, {}
    for i, d, a, b, winner, kind, shift_a, shift_b in sorted(rows, key=lambda x: (x[1], x[0])):
        for x in (a, b):
            if x in last and (d - last[x]).days / 365 > 0.5:
                elo[x] -= (elo[x] - 1500) * 0.1 * (d - last[x]).days / 365
        ea, eb = elo.get(a, 1500.0), elo.get(b, 1500.0)
        p = 1 / (1 + 10 ** ((eb - ea) / 400))
        if enhanced:
            first = winner is None or winner == a
            who, shift = (a, shift_a) if first else (b, shift_b)
            form = sum({"win": 0.02, "loss": -0.02}.get(x, 0) / (j + 1) for j, x in enumerate(reversed(past.get(who, [])[-3:])))
            q = max(0.05, min(0.95, (p if first else 1 - p) + 0.5 * (shift + form)))
            p = q if first else 1 - q
        score = 0.5 if winner is None else float(winner == a)
        change = 32 * {"title": 1.5, "main": 1.25, "regular": 1.0}[kind] * (score - p)
        elo[a], elo[b] = ea + change, eb - change
        last[a] = last[b] = d
        for x, won in ((a, score), (b, 1 - score)):
            past.setdefault(x, []).append("draw" if score == 0.5 else "win" if won else "loss")
        out[i, a], out[i, b] = elo[a], elo[b]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, d timestamp, a long, b long, winner long, kind string, shift_a double, shift_b double").repartition(3)


def test_ratings_beside_a_loop(spark):
    rows = contests()
    for enhanced in (False, True):
        want = loop(rows, enhanced)
        got = {(r["id"], r["entity"]): r["after"] for r in rating.rate(frame(spark, rows), enhanced=enhanced).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 9), (7, 8), (3, 1), (20, 10), (10, 30)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 7: 7, 8: 7, 10: 10, 20: 10, 30: 10}


def test_the_kernel_holds_no_contests():
    """A component of many batches gives each batch's ratings before it asks for the next one."""
    read = []

    def batches():
        for n in range(40):
            read.append(n)
            ids = range(n * 50, n * 50 + 50)
            columns = {"_g": [1] * 50, "id": list(ids), "d": [datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=i) for i in ids], "a": [1] * 50, "b": [2] * 50, "score": [1.0] * 50, "k": [32.0] * 50, "shift_a": [0.0] * 50, "shift_b": [0.0] * 50}
            yield pa.RecordBatch.from_pydict(columns)

    made = rating.run_contests(batches())
    first = next(made)
    assert first.num_rows == 50 and read == [0]
    rest = list(made)
    assert sum(b.num_rows for b in rest) == 1950 and rest[0].column("ra")[0].as_py() == first.column("ra")[49].as_py() + first.column("change")[49].as_py()


def test_links_that_close_a_cycle_go_before_the_rounds():
    r = random.Random(3)
    links = [(r.randrange(30), r.randrange(30)) for _ in range(2000)] + [(77, 77), (77, 77)]
    batch = lambda x: pa.RecordBatch.from_pydict({"u": [max(y) for y in x], "v": [min(y) for y in x]})
    kept = [(row["u"], row["v"]) for b in graph.forest(batch(links[i : i + 100]) for i in range(0, len(links), 100)) for row in b.to_pylist()]
    assert len(kept) <= 31 and kept.count((77, 77)) == 1 and {x for link in kept for x in link} == {x for link in links for x in link}
