from collections import Counter

import numpy as np

from corpus import frame, rows, words_of
from ringledger.llm import substrings, suffixes


def by_words(data, length):
    at = Counter()
    each = [words_of(t) for _, t in data]
    for w in each:
        at.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    for (i, _), w in zip(data, each):
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if at[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        yield i, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)


def by_bytes(data, length):
    key = lambda i: 2**62 if i is None else i
    least = {}
    each = [(t or "").encode() for _, t in data]
    for (i, _), t in zip(data, each):
        for j in range(len(t) - length + 1):
            s = t[j : j + length]
            least[s] = min(least.get(s, 2**63), key(i))
    for (i, _), t in zip(data, each):
        gone = [False] * len(t)
        for j in range(len(t) - length + 1):
            if least[t[j : j + length]] < key(i):
                gone[j : j + length] = [True] * length
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        yield i, bytes(x for x, g in zip(t, gone) if not g), len(t), sum(gone), spans


def periodic():
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join((words[:p] * 60)[: 60 + 7 * i])) for i, p in enumerate((1, 2, 3, 7, 13, 27, 28, 29, 35, 36))]


def test_periodic_texts(spark):
    for length, k in ((35, 8), (5, 2)):
        for i, t in periodic():  # each alone, so that windows repeat in one text only
            got = substrings.remove_repeated(frame(spark, [(i, t)]).coalesce(1), window=length, k=k).collect() if i % 3 == 0 or length == 35 and i < 6 else None
            assert got is None or Counter(map(tuple, got)) == Counter(by_words([(i, t)], length)), (length, i)


def test_words(spark):
    for length, k, mb in ((35, 8, 6.0), (35, 8, 0.002), (5, 2, 0.001)):
        got = substrings.remove_repeated(frame(spark), window=length, k=k, bundle_mb=mb).collect()
        assert Counter(map(tuple, got)) == Counter(by_words(rows(), length)), (length, mb)


def test_bytes(spark):
    for length, k, mb in ((50, 24, 6.0), (50, 24, 0.002), (16, 8, 0.001)):
        got = [(r[0], bytes(r[1]), *r[2:]) for r in suffixes.remove_seen(frame(spark), length=length, k=k, bundle_mb=mb).collect()]
        assert Counter(got) == Counter(by_bytes(rows(), length)), (length, mb)


def test_no_rows(spark):
    assert substrings.remove_repeated(frame(spark).limit(0)).collect() == []
    assert suffixes.remove_seen(frame(spark).limit(0)).collect() == []


def test_deep_shallow_orders_all():
    r = np.random.default_rng(1)
    data = np.concatenate([np.tile(r.integers(97, 100, 60), 20), r.integers(97, 99, 3000)]).astype(np.uint8)
    start = np.arange(len(data) - 50)
    group = (start % 3).astype(np.int64)
    order, label = suffixes.deep_shallow(data, start, group, 50, shallow=16)
    blob = data.tobytes()
    keys = [(int(group[i]), blob[i : i + 50]) for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == start.tolist()
    assert len(set(label.tolist())) == len(set(keys))
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], label.tolist(), label[1:].tolist()))
