"""Fuzzy names, Unicode names, keyword places and Python's rounding, against plain Python."""

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from ringledger.functions import numbers
from ringledger.functions import text as T
from ringledger.functions import unicode as U
from ringledger.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def names(seed, n, letters="abcd", lo=0, hi=7):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(lo, hi))) for _ in range(n)]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_index_finds_all_pairs(spark, k):
    a, b = names(1, 80), names(2, 60)
    left = spark.createDataFrame([(x, i % 2) for i, x in enumerate(a)] + [(None, 0)], "name string, g int")
    right = spark.createDataFrame([(x, i % 2) for i, x in enumerate(b)], "name string, g int")
    got = {(r["left_name"], r["right_name"], r["distance"]) for r in fuzzy.within(left, right, k).collect()}
    assert got == {(x, y, edits(x, y)) for x in a for y in b if edits(x, y) <= k}
    inside = {(r["g"], r["left_name"], r["right_name"]) for r in fuzzy.within(left, right, k, block=["g"]).collect()}
    assert inside == {(i % 2, x, y) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and edits(x, y) <= k}


def plain_tier(asked, known):
    words = asked.split(" ")
    initial, last = (asked[0] if len(words) > 1 else None), words[-1]
    best = None
    for i, name in known:
        if not name:
            continue
        ks = name.split(" ")
        ki, kl = (name[0] if len(ks) > 1 else None), ks[-1]
        options = [(1, 0)] if name == asked else []
        if initial and ki == initial and kl == last:
            options.append((2, 0))
        if initial and ki == initial and len(kl) >= 5 and len(last) >= 5 and edits(kl, last) <= 2:
            options.append((3, edits(kl, last)))
        if not initial and kl == last:
            options.append((4, 0))
        for o in options:
            best = min(best or (*o, i), (*o, i))
    return best or (None, None, None)


def test_tiers(spark):
    r = random.Random(5)
    pool = [f"{a} {b}".strip() for a, b in zip(names(3, 60, "xyz", 1, 3), names(4, 60, "abc", 3, 7), strict=True)]
    known = [(i, x) for i, x in enumerate(pool)] + [(100, "lone"), (101, ""), (102, "lone")]
    asked = [(i, r.choice(pool)) for i in range(20)] + [(50 + i, x) for i, x in enumerate(f"{a} {b}" for a, b in zip(names(6, 40, "xyz", 1, 3), names(7, 40, "abc", 4, 7), strict=True))]
    asked += [(200, pool[0].split(" ")[-1]), (201, "lone"), (202, ""), (203, "q nobodyatall")]
    got = {x["a"]: (x["tier"], x["distance"], x["k"]) for x in fuzzy.tiered(spark.createDataFrame(asked, "a int, name string"), spark.createDataFrame(known, "k int, name string"), "a", "k").collect()}
    assert got == {i: plain_tier(x, known) for i, x in asked}
    assert {t for t, *_ in got.values()} == {1, 2, 3, 4, None}


def test_unicode_names(spark):
    data = ["Quiñonez", "ŁUKASZ Jr.", "Dvořák  Šťastný", "ﬁne Ⅳ ①", "plain", "", None, "ß Ø", "étè"]
    got = [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").orderBy("i").select(U.unmarked("x"), U.plain_name(F.col("x"))).collect()]
    for x, (u, p) in zip(data, got, strict=True):
        assert u == (None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))
    assert got[0][1] == "quinonez" and got[1][1] == "łukasz" and got[2][1] == "dvorak stastny"


def test_keyword_places(spark):
    filler = "z" * 150
    rows = [
        (0, f"{filler} torn knee {filler} surgery soon", "Ann Lee"),
        (1, f"lee had a cut {filler}", "Ann Lee"),
        (2, f"a cut, lee; {filler} torn {filler}", "Ann Lee"),
        (3, "lee | torn by smith", "Ann Lee"),
        (4, "nothing", "Ann Lee"),
        (5, None, "Ann Lee"),
    ]
    df = spark.createDataFrame(rows, "i int, t string, n string").orderBy("i")
    free = [r[0] for r in df.select(T.keyword_mentions(F.col("t"), ["torn", "surgery"], ["cut"])).collect()]
    assert [[(m["keyword"], m["severity"]) for m in x or []] for x in free] == [[("torn", "major"), ("surgery", "major")], [("cut", "minor")], [("torn", "major")], [("torn", "major")], [], []]
    assert all(len(m["context"]) <= 207 for x in free for m in x or [])
    own = [r[0] for r in df.select(T.keyword_mentions(F.col("t"), ["torn", "surgery"], ["cut"], name=F.col("n"))).collect()]
    assert [[m["keyword"] for m in x or []] for x in own] == [[], ["cut"], ["cut"], [], [], []]


def test_rounding_equals_python(spark):
    r = random.Random(8)
    values = [1.015, 2.675, 0.5, 1.5, 2.5, 0.125, 0.375, -2.675, -0.001, 0.0, -0.0, 1e15, 1e300, 4503599627370497.5, float("inf"), float("-inf"), 5e-324, 1.005, 1.115]
    values += [r.uniform(-1000, 1000) for _ in range(40000)] + [r.randrange(10**6) / 1000 for _ in range(30000)] + [r.randrange(10**6) / 2**r.randrange(12) for _ in range(20000)] + [r.uniform(-1, 1) * 10 ** r.randrange(-8, 16) for _ in range(10000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for digits in (0, 1, 2, 4, 7):
        got = df.select("x", numbers.python_round(F.col("x"), digits).alias("y")).collect()
        for x, y in got:
            want = x if x is None or abs(x) == float("inf") else round(x, digits)
            assert y == want and str(y) == str(float(want) if want is not None else None), (x, digits, y, want)
    assert str(spark.sql("select double('NaN') x").select(numbers.python_round(F.col("x"), 2)).first()[0]) == "nan"


def test_contexts_are_the_patterns_and_fast():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["a", "b", "ab", "\n", "é", "\U0001f600", "lic", "aa"]) for _ in range(r.randrange(40)))
        word, n = r.choice(["ab", "aa", "lic", "aba"]), r.randrange(6)
        assert T.contexts(text, word, n) == re.findall(f"(?s).{{0,{n}}}{word}.{{0,{n}}}", text)
    began = time.process_time()
    assert len(T.contexts("no " * 3_000_000 + "license", "license", 100)) == 1
    assert time.process_time() - began < 1  # the pattern takes half a minute


def test_contexts_of_a_column(spark):
    df = spark.createDataFrame([(1, "A License here"), (2, "none"), (3, None), (4, "license " * 40)], "id long, t string")
    got = {x["id"]: x["c"] for x in df.select("id", T.in_context(F.col("t"), "license", 20).alias("c")).collect()}
    assert got == {1: ["a license here"], 2: [], 3: None, 4: re.findall("(?s).{0,20}license.{0,20}", "license " * 40)}


def test_leading_words_are_those_of_the_whole_text(spark):
    r = random.Random(12)
    pieces = ["ab", "É", "q1", "--", " ", "  ", "\n", "´", " ", "ﬁ", "x", "Ǆ", "7", "é́", "\t"]
    data = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(1500)] + [None, "", "a b", "a " + "-" * 50 + " b c", "élan Ĳ b c d"]
    df = spark.createDataFrame([(x,) for x in data], "t string")
    for head in (1, 6, 20):
        got = df.select(U.leading(F.col("t"), 2, head).alias("g"), F.array_join(F.slice(F.split(U.letters(F.col("t")), " "), 1, 2), " ").alias("w")).collect()
        assert [g for g, _ in got] == [w for _, w in got]


def test_leading_words_read_a_head_and_far_lengths_are_not_cut(spark, monkeypatch):
    """A whole text went to Python for two words, and each known word was cut, 70 letters into 2500 keys."""
    sent = spark.createDataFrame([("one two three " + "four " * 9000,)], "t string")
    plan = sent.select(U.leading(F.col("t"), 2).alias("x"))
    assert plan.first()[0] == "one two" and "substring(t" in plan._jdf.queryExecution().optimizedPlan().toString()
    cut = []
    real = fuzzy.within
    monkeypatch.setattr(fuzzy, "within", lambda a, b, *x, **y: cut.append(b) or real(a, b, *x, **y))
    known = spark.createDataFrame([(1, "ann smithe"), (2, "ann " + "z" * 70), (3, "bob smithe"), (4, "ann smithsons")], "k int, name string")
    asked = spark.createDataFrame([(1, "ann smitha")], "a int, name string")
    assert [tuple(x) for x in fuzzy.tiered(asked, known, "a", "k").collect()] == [(1, 3, 1, 1)]
    assert [x["name"] for x in cut[0].collect()] == ["smithe"]
