"""A passage that very many texts hold: its minimisers' windows are dealt one by one, and the results stay the same."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corpus import frame, rows
from ringledger.llm import substrings, suffixes
from ringledger.llm import superkmers as S
from test_repeats import by_bytes, by_words


def documents(n=3000, seed=3):
    r = random.Random(seed)
    some = lambda k: [f"w{r.randrange(5000)}" for _ in range(k)]
    passage = some(60)
    return [(i, " ".join(some(r.randint(20, 40)) + passage + some(r.randint(20, 40)))) for i in range(n)]


def sent(data, bundles, limit, length=35, k=8):
    """How many super-k-mers all bundles send for each minimiser, as mark() does it."""
    texts = [substrings.read_words(pa.table({"doc_id": [i for i, _ in data[b::bundles]], "text": [t for _, t in data[b::bundles]]}), k) for b in range(bundles)]
    found = [S.find_runs(t, length, k, 1) for t in texts]
    asked = pa.concat_tables([S.ask(b, f, S.sketch(t, f, length, k)) for b, (t, f) in enumerate(zip(texts, found))])
    told = S.answer_within(asked, limit)
    names = Counter()
    for b, (t, f) in enumerate(zip(texts, found)):
        cut = S.single_windows(t, *S.shared_runs(f, told.filter(pa.array(np.array(told["b"]) == b))), length, k, 1)
        t.piece = lambda x, y, t=t: b" ".join(t.own[x : y + length - 1])
        names.update(S.distinct(t, cut).name.tolist())
    return names


def test_groups_stay_bounded():
    few, many = documents(1500), documents(3000)
    assert max(sent(few, 100, 10**9).values()) > 1000
    assert max(sent(many, 200, 10**9).values()) > 2000  # in proportion to the documents
    # cut: at most a window's one entry for each bundle, or a minimiser's below the limit
    assert max(sent(few, 100, S.HOT).values()) <= 110
    assert max(sent(many, 200, S.HOT).values()) <= 220


def test_results_stay_the_same(spark):
    data = documents(400)
    for hot, mb in ((2, 0.002), (S.HOT, 0.002), (3, 6.0)):
        got = substrings.remove_repeated(frame(spark, data), bundle_mb=mb, hot=hot).collect()
        assert Counter(map(tuple, got)) == Counter(by_words(data, 35)), (hot, mb)
    got = [(r[0], bytes(r[1]), *r[2:]) for r in suffixes.remove_seen(frame(spark, data[:120]), bundle_mb=0.001, hot=2).collect()]
    assert Counter(got) == Counter(by_bytes(data[:120], 50))


def test_defined_cases_cut(spark):
    for length, k in ((35, 8), (5, 2)):
        got = substrings.remove_repeated(frame(spark), window=length, k=k, bundle_mb=0.001, hot=1).collect()
        assert Counter(map(tuple, got)) == Counter(by_words(rows(), length)), length
    for length, k in ((50, 24), (16, 8)):
        got = [(r[0], bytes(r[1]), *r[2:]) for r in suffixes.remove_seen(frame(spark), length=length, k=k, bundle_mb=0.001, hot=1).collect()]
        assert Counter(got) == Counter(by_bytes(rows(), length)), length
