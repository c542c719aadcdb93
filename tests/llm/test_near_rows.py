"""Near-duplicate search where ids are missing or repeat, where column names clash, and where one text has many copies."""

import random

import pytest

from ringledger.llm import neardup


def base(seed, n=100):
    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def edited(words, *places):
    out = list(words)
    for p in places:
        out[p] = f"new{p}"
    return out


def docs(spark, rows, parts=2):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(parts)


def test_a_row_without_id_links_others(spark):
    a = base(1)
    m, b = edited(a, 20), edited(a, 20, 60, 80)  # a is near m, m near b, a not near b
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, [(1, a), (None, m), (2, b)]), width=4).collect()}
    alone = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, [(1, a), (2, b)]), width=4).collect()}
    assert alone == {1: 1, 2: 2}
    assert {i: (r["component_id"], r["kept"]) for i, r in got.items()} == {1: (1, True), 2: (1, False), None: (1, False)}


@pytest.mark.parametrize("parts", [1, 3])
def test_one_id_with_two_texts(spark, parts):
    a, b = base(2), base(3)
    rows = [(1, a), (1, b), (2, edited(a, 50)), (3, edited(b, 50))]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, rows, parts), width=4).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    kept = neardup.drop_near_duplicates(docs(spark, rows, parts), width=4).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((i, " ".join(t)) for i, t in rows[:2])


def test_clashing_columns_and_rows_without_id(spark):
    a = base(4)
    rows = [(i, " ".join(t) if t is not None else None) for i, t in [(5, a), (4, edited(a, 9)), (None, base(5)), (None, base(5)), (None, []), (None, []), (None, None), (8, []), (8, [])]]
    names = ["_n", "_kept", "row", "n", "rid", "root", "node", "set_key", "b"]
    df = spark.createDataFrame([(*x, *range(len(names))) for x in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(4, rows[1][1]), (None, rows[2][1]), (None, ""), (None, ""), (None, None), (8, "")]
    assert got == sorted(want, key=str)


def test_many_copies(spark):
    a = base(6)
    rows = [(i, a) for i in range(100, 400)] + [(i, base(1000 + i)) for i in range(50)] + [(7000, edited(a, 30))]
    got = neardup.near_duplicates(docs(spark, rows), width=4).collect()
    assert {r["component_id"] for r in got if r["doc_id"] >= 100} == {100} and sum(r["kept"] for r in got) == 51
