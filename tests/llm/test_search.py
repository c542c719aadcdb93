"""TPUT against a full scan in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from ringledger.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    counts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    counts = [c for c in counts if c[2]]
    n_docs, total = len(counts), sum(c[2] for c in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in counts:
            m = 10 + (90 * n * n_docs) // total
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc if doc is not None else 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"t{i}" for i in range(60)] + ["Été", "the", "THE", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, r.choice([" ", "-", "_\n"]).join(r.choices(words, weights, k=r.randint(1, 80)))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)] + [(None, rows[4][1]), (5, rows[5][1]), (n + 50, None), (n + 51, " ... "), (n + 52, "")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(20)]
    return rows, items + [(20, None), (21, "nosuchterm"), (22, "-"), (3, items[3][1]), (None, items[4][1]), (23, "the the THE nosuchterm")]


@pytest.mark.parametrize("chunk", [7, 200_000])
def test_equals_full_scan(spark, monkeypatch, chunk):
    monkeypatch.setattr(search, "CHUNK", chunk)
    monkeypatch.setattr(search, "TASK", 5 * chunk)
    rows, items = corpus(chunk, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(search.search(docs, asked)) == plain(rows, items)


def test_blocks_of_queries_and_small_top(spark):
    rows, items = corpus(1, 100)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item int, key int")
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, term int")
    assert found(search.search(docs, asked, top=3, block_bytes=200)) == plain(rows, items, 3)


def test_few_documents_and_empty_tables(spark):
    docs, items = [(1, "a b"), (2, "b c c"), (3, "")], [(7, "b"), (8, "a c")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(search.search(d, q)) == plain(docs, items)
    assert found(search.search(d.limit(0), q)) == [] and found(search.search(d, q.limit(0))) == []


def test_pruning_keeps_few_candidates(spark):
    """Of documents that share only a frequent term with a query, none is looked up."""
    docs = [(i, "common " + " ".join(f"r{i}x{j}" for j in range(5))) for i in range(500)] + [(1000 + i, f"rare common {i}") for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "rare common")]
    seen = []
    real = search.exact
    search.exact = lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a)
    try:
        got = found(search.search(d, spark.createDataFrame(items, "item_id long, text string")))
    finally:
        search.exact = real
    assert got == plain(docs, items) and seen[-1] == 12
