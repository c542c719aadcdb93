"""What linking of lines need not do, and that it loses nothing by it, without Spark."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from ringledger.llm import lines, minhash
from ringledger.llm import superkmers as S


def family(n, length, seed):
    r = random.Random(seed)
    base = [r.choice("abcdefghij ") for _ in range(length)]
    out = []
    for _ in range(n):
        text = base.copy()
        text[r.randrange(length)] = "#"
        out.append("".join(text))
    return sorted(set(out))


def test_lines_that_links_join_already_are_not_compared(monkeypatch):
    near, apart = family(60, 200, 1), [family(1, 200, k)[0] for k in range(2, 12)]
    text = near + apart
    node = [7 * i + 3 for i in range(len(text))]
    compared, common = [0], lines.common

    def counted(names, first, x, y):
        compared[0] += len(x)
        return common(names, first, x, y)

    monkeypatch.setattr(lines, "common", counted)
    got = lines.small_links(pa.table({"bucket": [1] * len(text), "node": node}), pa.table({"node": node, "text": text}), 5, 80)
    assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist())) == [(3, x) for x in node[1 : len(near)]]
    assert compared[0] < 4 * len(text)


def test_the_bound_excludes_no_link():
    text = family(20, 60, 1) + family(20, 300, 2) + family(20, 5000, 3) + ["a", "", "ab" * 50]
    names, first = lines.line_sets(text, 5)
    x, y = (np.array(z) for z in zip(*combinations(range(len(text)), 2)))
    size, both = np.diff(first), lines.common(names, first, x, y)
    linked = 100 * both >= 80 * (size[x] + size[y] - both)
    kept = lines.may_fit(names, first, x, y, 80)
    assert kept[linked].all() and not kept.all()


def test_sparse_rows_are_filled_as_tries_would():
    r = np.random.default_rng(5)
    values = r.integers(0, 1 << 31, (300, 40), dtype=np.uint32)
    values[r.random((300, 40)) < np.linspace(0, 1, 300)[:, None]] = minhash.EMPTY
    want = values.copy()
    for i, j in zip(*np.nonzero(values == minhash.EMPTY)):
        k = 0
        while want[i, j] == minhash.EMPTY and (values[i] != minhash.EMPTY).any():
            k += 1
            want[i, j] = values[i, minhash.places(40, k)[j]]
    assert (minhash.densify(values.copy()) == want).all()


def test_told_names_are_those_of_the_answers():
    r = np.random.default_rng(6)
    name = r.integers(0, 500, 2000, dtype=np.uint64)
    none = np.zeros(0, np.int64)
    found = S.Runs(none, none, name, (name % np.uint64(3)).astype(np.int64), none)
    group, distinct, place, _ = S.names_by_group(found)
    hot = distinct % 7 == 0
    answers = pa.table({"g": [0, 1, 2], "bits": [np.packbits(hot[group == g]).tobytes() for g in range(3)]})
    assert (S.told_names(found, answers) == hot[place]).all() and hot.any()
