import random
import re
from collections import Counter, defaultdict

import numpy as np

from corpus import frame, rows
from ringledger.llm import components, lines, minhash, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_data():
    r = random.Random(11)
    data = [x for x in rows() if x[0] is not None and x[0] < 60]
    vocab = [f"w{i}" for i in range(400)]
    for g in range(6):
        base = [r.choice(vocab) for _ in range(r.choice([6, 40, 120]))]
        for c in range(9):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 5])):
                t[r.randrange(len(t))] = r.choice(vocab)
            data.append((1000 - 10 * g + c, " ".join(t) if c % 2 else "\n".join(t).upper()))
    return data


def test_near_duplicates(spark):
    data = near_data()
    sets = []
    for _, t in data:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = roots(len(data), links)
    least = {k: min(data[i][0] for i in range(len(data)) if root[i] == k) for k in set(root)}
    want = Counter((d, len(s), least[k], d == least[k]) for (d, _), s, k in zip(data, sets, root))
    got = Counter(map(tuple, neardup.near_duplicates(frame(spark, data), width=4).collect()))
    assert got == want
    one = neardup.drop_near_duplicates(frame(spark, data), width=4)
    assert one.columns == frame(spark).columns and Counter(r["doc_id"] for r in one.collect()) == Counter(set(least.values()))


def test_odd_rows(spark):
    got = neardup.near_duplicates(frame(spark), width=4).collect()
    assert len(got) == len(rows())
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(6, False), (None, True)}
    kept = neardup.drop_near_duplicates(frame(spark), width=4).collect()
    assert sum(r["doc_id"] == 6 for r in kept) == 1 and neardup.near_duplicates(frame(spark).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    n = 300
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(r.randrange(180, n), r.randrange(180, n)) for _ in range(60)] + [(5, 5)]
    want = roots(n, links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {x["node"]: x["root"] for x in components.components(df).collect()}
    assert all(got.get(i, i) == want[i] for i in range(n))
    assert components.components(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    for size in (4, 20, 500):
        agree = []
        for _ in range(150):
            pool = r.integers(0, 2**63, 2 * size).astype(np.uint64)
            a, b = pool[:size], np.concatenate((pool[size // 4 : size], pool[size : size + size // 4]))
            s = minhash.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 64)
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - (size - size // 4) / (size + size // 4)) < 0.06


def test_lines(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefghij klm") for _ in range(k)) for k in (3, 8, 30, 60, 90, 200, 200)]
    data = []
    for i in range(80):
        out = []
        for _ in range(r.randint(0, 5)):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice("xyz")
            out.append("".join(t))
        data.append((i, "\n".join(out) + r.choice(["", "\n", "\n \n"])))
    data += [(80, None), (81, ""), (81, data[7][1]), (None, data[9][1]), (82, "ü" * 9 + "\n" + "ü" * 12)]
    occ = [((2**63 - 1 if d is None else d, n), line) for d, t in data for n, line in enumerate((t or "").split("\n")) if line.strip()]
    distinct = sorted({x for _, x in occ})
    sets = [lines.shingles(x, 8) for x in distinct]
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = dict(zip(distinct, roots(len(distinct), links)))
    first = defaultdict(lambda: (2**63, 0))
    for at, line in occ:
        first[root[line]] = min(first[root[line]], at)
    want = Counter()
    for d, t in data:
        kept, gone, total = [], 0, 0
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                total += 1
                if first[root[line]] != (2**63 - 1 if d is None else d, n):
                    gone += 1
                    continue
            kept.append(line)
        want[d, None if t is None else "\n".join(kept), total, gone] += 1
    for mb in (6.0, 0.003):
        got = Counter(map(tuple, lines.dedup(frame(spark, data), bundle_mb=mb).collect()))
        assert got == want
    assert lines.dedup(frame(spark).limit(0)).count() == 0
