"""SimHash: fingerprints by bit counts, BK-trees against all pairs, shards that are dealt again, components."""

import random

import numpy as np
import pytest
import xxhash

import corpus
from ringledger.llm import simhash


def plain_fingerprint(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = data.split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, f"{fp:016x}", least.get(top(i))) for i, ((doc, _), fp) in enumerate(zip(rows, fps, strict=True))), key=str)


def found(df):
    return sorted(((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [3, 20000])
def test_corpus(spark, most):
    rows = corpus.rows()
    got = simhash.near_duplicates(corpus.frame(spark, rows), most=most)
    assert found(got) == plain_components(rows)


def test_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        words[r.randrange(400)] = f"new{i}"
        rows.append((500 - i, " ".join(words)))
    rows += [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(50))) for i in range(40)]
    want = plain_components(rows)
    assert len({c for *_, c in want}) < 80
    for most in (2, 20000):
        assert found(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=most)) == want


def test_tree_finds_all_pairs_and_prunes():
    r = np.random.default_rng(5)
    value = np.unique(np.concatenate([r.integers(0, 2**63, 800).astype(np.uint64)] * 2 + [np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)]))
    near = value[:300] ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64))
    value = np.unique(np.concatenate([value, near]))
    tree = simhash.Tree(value)
    for radius in (0, 1, 2, 5):
        got = {(n, int(q)) for n, some in tree.search(value, radius) for q in some}
        want = {(i, int(j)) for i in range(len(value)) for j in np.flatnonzero(np.bitwise_count(value ^ value[i]) <= radius)}
        assert got == want
    for i, below in enumerate(tree.child):
        assert all(int(value[i] ^ value[j]).bit_count() == d for d, j in below.items())


def test_masks_cover_all_bits():
    below = simhash.masks_below(0, 2)
    assert [m.bit_count() for m in below] == [21, 21, 22] and sum(below) == 2**64 - 1
    deeper = simhash.masks_below(below[1], 2)
    assert all(m & below[1] == below[1] for m in deeper) and deeper[0] | deeper[1] | deeper[2] == 2**64 - 1
    assert simhash.masks_below(2**64 - 2, 2) == [2**64 - 1]


@pytest.mark.parametrize("size", [5, 16, 1000])
def test_long_texts_in_stretches(size):
    r = random.Random(size)
    text = "".join(r.choice(["ab", "é", " ", "\n", "longer-word" * 5, "  ", "\t"]) for _ in range(600)).encode()
    assert [w for part in simhash.stretches(text, size) for w in part] == text.split()
    long = ("x" * 3_000_000 + " y z " + "some words of a long text " * 90_000).encode()
    assert simhash.fingerprint(long) == simhash.fingerprint(long.replace(b" ", b" \n "))
    assert simhash.fingerprint(long[3_000_000:]) == plain_fingerprint(long[3_000_000:].decode())


def test_empty_table_and_clashing_names(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8), (None, None, 0, 0), (9, "", 0, 0)], "doc_id long, text string, fp int, component_id int")
    assert found(simhash.near_duplicates(odd)) == plain_components([(1, "a b c d"), (2, "a b c d"), (None, None), (9, "")])


def test_dense_fingerprints_in_the_smallest_shards(spark):
    """All patterns of five bits, and some far from them: shards are dealt again until few bits are left, and no link is lost."""
    fps = [x << 20 for x in range(32) if x.bit_count() % 2 == 0] + [(1 << 40) + (1 << 50), (1 << 62) + 3 * (1 << 30)]
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, most=1).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    group = lambda pairs: {frozenset(x) for x in joined(fps, pairs)}
    assert group(links) == group([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])


def joined(nodes, pairs):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    out = {}
    for x in nodes:
        out.setdefault(top(x), []).append(x)
    return out.values()
