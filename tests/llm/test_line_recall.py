"""Recall of the bands of line deduplication, and its counting of common shingles, without Spark."""

import random
from itertools import combinations

import numpy as np
import pytest

from ringledger.llm import lines


def edited_lines(n, least, most):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7)))
    out = []
    for _ in range(n):
        base = ""
        while len(base) < r.randint(least, most):
            base += word() + " "
        k = r.randrange(len(base))
        out += [base, base[:k] + "#" + base[k + 1 :], base + word()]
    return out


@pytest.mark.parametrize("width", [4, 5, 8])
def test_recall_of_bands(width):
    text = edited_lines(150, 40, 200)
    sets = [lines.shingles(x, width) for x in text]
    links = [(i, j) for k in range(0, len(text), 3) for i, j in combinations(range(k, k + 3), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    bands = lines.dealt_bands(lines.signatures(text, width))
    found = sum(bool(np.intersect1d(bands[i], bands[j]).size) for i, j in links)
    assert len(links) > 100 and found >= 0.99 * len(links)


@pytest.mark.parametrize("width", [1, 3, 5, 8])
def test_common_shingles(width):
    text = ["abc", "hello world hello world", "x", "zzzzzzzzzzz", "ünïcödé 😀 text here", "ab" * 40, "y" * 300_000]
    names, first = lines.line_sets(text, width)
    sets = [lines.shingles(x, width) for x in text]
    assert np.diff(first).tolist() == [len(s) for s in sets]
    pairs = list(combinations(range(len(text)), 2))
    x, y = (np.array(z) for z in zip(*pairs))
    assert lines.common(names, first, x, y).tolist() == [len(sets[i] & sets[j]) for i, j in pairs]
