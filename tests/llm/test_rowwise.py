import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpus import frame, rows
from ringledger.llm import decontam, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def folded(t):
    return FOLDED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(data, items, window):
    wins = defaultdict(set)
    for i, t in items:
        w = folded(t)
        if w:
            for j in range(max(1, len(w) - window + 1)):
                wins[tuple(w[j : j + window])].add("null" if i is None else str(i))
    for d, t in data:
        w = folded(t)
        hit, names = set(), set()
        for win, who in wins.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit.update(range(j, j + len(win)))
                    names |= who
        yield d, len(w), len(hit), tuple(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [4_000_000, 200])
def test_decontamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    data = rows()
    r = random.Random(3)
    items = [(i, " ".join((data[r.randrange(7, 60)][1] or "").split()[: r.choice([1, 2, 5, 14, 30])])) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (None, "CHANGED"), (53, "a"), (54, items[0][1]), (55, "quite absent words here")]
    got = decontam.find(frame(spark), bench(spark, items)).collect()
    assert Counter((g[0], g[1], g[2], tuple(g[4]), g[5]) for g in got) == Counter(brute_hits(data, items, 13))
    kept = decontam.drop_contaminated(frame(spark), bench(spark, items))
    assert kept.columns == frame(spark).columns
    assert Counter(x["doc_id"] for x in kept.collect()) == Counter(g[0] for g in got if not g[5])
    assert decontam.find(frame(spark).limit(0), bench(spark, items)).count() == 0
    assert not any(g["n_hit"] for g in decontam.find(frame(spark), bench(spark, [])).collect())


def sourced(spark):
    r = random.Random(5)
    data = [(i, t, r.choice(["b", "a", "é", "Z", None]) if i != 6 else "lone") for i, t in rows(n=200)]
    return data, spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)


def test_mixing(spark):
    data, docs = sourced(spark)
    size = [len(WORD.findall(t or "")) for _, t, _ in data]
    by = defaultdict(int)
    for (_, _, s), n in zip(data, size):
        by[s] += n
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = dict(zip(names, [3, 1, 2] * 9))
    target, over = {}, set()
    while True:
        left = 1.5 * sum(size) - sum(2 * by[s] for s in over)
        w = sum(weight[s] for s in names if s not in over)
        target = {s: 2 * by[s] if s in over else left * weight[s] / w for s in names}
        new = {s for s in names if s not in over and target[s] > 2 * by[s]}
        if not new:
            break
        over |= new
    got = mixing.assign(docs).collect()
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((i, n) for (i, _, _), n in zip(data, size))
    taken = defaultdict(int)
    for g in got:
        s = next(x for i, _, x in data if i == g["doc_id"])
        assert g["source_size"] in by.values() and all(0 <= c["position"] <= 1 for c in g["copies"])
        assert sum(c["words"] for c in g["copies"]) <= 2 * g["size"]
        if g["doc_id"] is not None and g["doc_id"] < 200:
            assert g["source_size"] == by[s] and g["target"] == pytest.approx(target[s])
        taken[(g["source_size"], g["target"])] += sum(c["words"] for c in g["copies"])
    for (_, t), n in taken.items():
        assert abs(n - t) <= 1
    again = mixing.assign(docs.repartition(7)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(len(g["copies"]) for g in got)
    assert mixing.assign(docs.limit(0)).count() == 0


def test_curriculum_inverts_the_schedule(spark):
    done = spark.range(0, 101).selectExpr("id / 100.0D as d", "cast(id % 3 as int) as turn")
    from pyspark.sql import functions as F

    for d, turn, t in done.select("d", "turn", mixing.moment(F.col("turn"), F.col("d"), mixing.SCHEDULES)).collect():
        knots = mixing.SCHEDULES[turn]

        def area(x):
            total = 0.0
            for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
                b = min(max(x, t0), t1)
                total += (b - t0) * (m0 + m0 + (m1 - m0) * (b - t0) / (t1 - t0)) / 2
            return total

        assert area(t) == pytest.approx(d * area(1.0), abs=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 66, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 4)).collect()]
    assert sorted(got) == list(range(n)) and (n < 66 or got != sorted(got))


def test_sharding(spark):
    docs = frame(spark).withColumnRenamed("b", "Slot")
    got = sharding.shard(docs, 24).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24
    again = sharding.shard(docs.repartition(5), 24).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    assert sharding.shard(docs.limit(0)).collect() == []


def test_quality(spark):
    nav = "Home | News | Sport | About us now"
    good = "This is a fine sentence of eight words."
    varied = "\n".join(f"Line w{i} has x{i} some y{i} fresh z{i} text." for i in range(9))
    data = rows() + [(900, "\n".join([nav] * 2 + [varied])), (901, varied + "\nAll rights reserved.\nHeading"), (902, varied.replace(".", "")), (903, varied.replace(" ", "!! ") + "."), (904, "\n".join(f"a{i} | b{i} | c{i} | d{i}." for i in range(20))), (905, good + "\n" + good)]
    got = {r["doc_id"]: r for r in quality.rules(frame(spark, data)).collect()}
    for i, t in data:
        t = t or ""
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {j + x for j in range(len(w) - 2) for x in range(3) if tri[tuple(w[j : j + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        if i is not None and i != 60:
            assert tuple(got[i])[1:6] == want, i
            assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
    assert got[900]["kept"] and nav not in got[900]["cleaned"] and got[900]["cleaned"] == varied
    assert got[901]["kept"] and got[901]["cleaned"] == varied + "\nHeading"
    assert not got[902]["kept"] and not got[903]["kept"] and not got[904]["kept"] and got[905]["base_failed"]
    kept = quality.clean(frame(spark, data))
    assert kept.columns == frame(spark).columns
    kept = kept.collect()
    assert {r["doc_id"] for r in kept} == {i for i, r in got.items() if r["kept"]}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept}[901] == (varied + "\nHeading", len(varied) + 8)
    assert quality.rules(frame(spark).limit(0)).collect() == []
    assert zlib.crc32(b"") == 0
