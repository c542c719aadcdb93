"""Operator 10, fuzzy line deduplication: one line of each component of similar lines stays, its first.

Lines are split at line feeds; lines without a word always stay. The distinct shingles of `width` characters of a line
(a shorter line as a whole) give a one-permutation MinHash signature, and its bands the buckets. Pairs of a bucket are
verified by their exact Jaccard similarity, links make components (components.py), and of each component the
occurrence with the smallest (doc_id, line number) stays; equal lines are one line with several occurrences.

1. Equal lines: each bundle of documents asks by 64-bit names which of its lines other bundles have too; the first
   bundle of a line represents it. (Two lines whose names agree by chance stay lines of their own.)
2. Most lines have no other relative: bundles ask by 32-bit names which bands of the lines they represent occur elsewhere
   or twice (superkmers.ask and answer), so that only lines with a shared band travel with their text, once.
3. Buckets with the same members count once. Buckets of up to SMALL lines are dealt into chunks by their smallest member, so that the buckets of one family meet
   and a text travels once a chunk. A chunk counts the common shingles of a pair once, unless sizes or a bound from bits
   exclude the pair or other links join its lines already; it writes no pairs, and gives a star around the first line of
   each component. A line is in BANDS buckets at most, which bounds its partners here.
4. Larger buckets hold families of edited copies; stars.py finds their links without looking at all pairs.

Recall: 40 bands of 6 bins would miss a pair at exactly 80 % with a chance of 5e-6 if they shared no bins; here 120
bins are dealt twice, the second time in another order. The query takes shingles of five characters: one changed
character costs five of them, so that a line of 49 characters or more still reaches 80 %. They are shared by chance
more often than longer ones; six bins a band keep unrelated lines out of the buckets. Shingles are compared by names
of 52 bits; two of one pair agree by chance once in 1e10 pairs.

Defined cases: a null text has no lines and stays null; repeated rows of one id count as copies: of lines with equal
(doc_id, line number) all stay; a row without an id counts as the last; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm import minhash
from ringledger.llm import superkmers as S
from ringledger.llm.common import U64, bundle_of, mix, parts, split_blobs, stored, text_bytes
from ringledger.llm.components import components
from ringledger.llm.stars import resolve

ROWS, BINS, DEALS = 6, 120, 2
BANDS = DEALS * BINS // ROWS
BLANK = "\x20\t\n\x0b\x0c\r"
#: Lines of a bucket that is tested pair by pair in one task.
SMALL = 64
#: Bits that tell of a set, without its members, which others it can't be similar to.
BITS = 2048
#: Rounds of one pair for each line, before all pairs that are left.
ROUNDS = 3
#: Bits of a shingle's name, and names that are compared at once.
NAME_BITS, AT_ONCE = 52, 200_000
#: Lines and characters that are hashed at once.
PART_LINES, PART_CHARS = 400, 60_000

SAME_ASK = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("names", pa.binary())])
SAME_ANSWER = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("bits", pa.binary()), ("mine", pa.binary())])
CANDIDATE = pa.schema([("b", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int64()), ("node", pa.int64()), ("text", pa.string()), ("bands", pa.list_(pa.int64()))])
CANDIDATE_DDL = "b int, key binary, doc_id long, line long, node long, text string, bands array<long>"


def window_names(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for the window that starts at each character of the joined lines, and the number of its line.

    Where no window starts, the number is len(lines). A shorter line is a window as a whole.
    """
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(size)
    names = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(U64)
    total, held, base = len(names), 1, 0x9E3779B97F4A7C15
    points = names
    while held < width:  # the hash of a window from those of two halves, or of all but its last character
        step = held if 2 * held <= width else 1
        more = names[step:] if step == held else points[held:]
        names = names[: max(0, len(names) - step)] * U64(pow(base, step, 1 << 64))
        names += more
        held += step
    out = np.zeros(total, U64)
    out[: len(names)] = names
    owner = np.repeat(np.arange(len(lines)), size)
    for j in range(1, width):
        owner[end[size >= j] - j] = len(lines)
    out = mix(out)
    for i in np.flatnonzero((size > 0) & (size < width)).tolist():
        out[end[i] - size[i]], owner[end[i] - size[i]] = xxhash.xxh3_64_intdigest(lines[i].encode()), i
    return out, owner


def line_sets(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each line as sorted names of NAME_BITS bits, and the n + 1 offsets."""
    found, sizes = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for place in in_cache(lines):
        part = lines[place]
        names, owner = window_names(part, width)
        both = (owner.astype(U64) << U64(NAME_BITS)) | (names >> U64(64 - NAME_BITS))
        both = both[owner < len(part)]
        both.sort()
        new = np.ones(len(both), bool)
        np.not_equal(both[1:], both[:-1], out=new[1:])
        both = both[new]
        found.append(both & U64((1 << NAME_BITS) - 1))
        sizes.append(np.bincount((both >> U64(NAME_BITS)).astype(np.int64), minlength=len(part)))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def in_cache(lines: list[str]) -> list[slice]:
    """The lines in parts whose arrays fit the processor's cache: PART_LINES lines, and PART_CHARS characters or one line, at most."""
    out, a, chars = [], 0, 0
    for i, n in enumerate(map(len, lines)):
        if i > a and (i - a == PART_LINES or chars + n > PART_CHARS):
            out.append(slice(a, i))
            a, chars = i, 0
        chars += n
    return [*out, slice(a, len(lines))]


def signatures(lines: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(lines), BINS), np.uint32)
    for part in in_cache(lines):
        names, owner = window_names(lines[part], width)
        out[part] = minhash.least_values(names, owner, part.stop - part.start + 1, BINS)[:-1]
    for a in range(0, len(lines), 4000):
        minhash.densify(out[a : a + 4000])
    return out


def dealt_bands(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes: the bins in order, then in other fixed orders."""
    orders = [np.argsort(mix(np.arange(BINS, dtype=U64) + U64(1000 * k))) if k else np.arange(BINS) for k in range(DEALS)]
    out = np.empty((len(signature), BANDS), U64)
    for a in range(0, len(signature), PART_LINES):
        part = signature[a : a + PART_LINES]
        out[a : a + PART_LINES] = np.concatenate([mix(minhash.bands(part[:, x], ROWS) + U64(k)) for k, x in enumerate(orders)], axis=1)
    return out


class Lines:
    """The distinct lines of a bundle with the first occurrence of each."""

    def __init__(self, table: pa.Table) -> None:
        ids = table["doc_id"].fill_null(S.NO_ID).to_numpy().astype(np.int64)
        first: dict[str, tuple[int, int]] = {}
        for i, text in zip(ids.tolist(), table["text"].to_pylist(), strict=True):
            for n, line in enumerate((text or "").split("\n")):
                if line.strip(BLANK) and (line not in first or (i, n) < first[line]):
                    first[line] = (i, n)
        self.text = sorted(first)
        self.at = [first[x] for x in self.text]

    def names(self, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A 64-bit name of each line, its group, and the order of (group, name)."""
        name = np.frombuffer(b"".join(map(key_of, self.text)), np.uint64)[::2]
        group = ((name >> U64(32)) % U64(groups)).astype(np.int64)
        return name, group, np.lexsort((name, group))

    def ask_same(self, bundle: int, groups: int) -> pa.Table:
        name, group, order = self.names(groups)
        cuts = S.runs(group[order])
        heads = group[order][cuts[:-1]]
        return pa.table([pa.array(heads, pa.int32()), pa.array(np.full(len(heads), bundle), pa.int32()), pa.array(split_blobs(name[order], cuts), pa.binary())], schema=SAME_ASK)

    def told_same(self, groups: int, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which lines other bundles have too, and which this one represents."""
        _, group, order = self.names(groups)
        out = np.zeros((2, len(order)), bool)
        out[:, order] = [S.told_bits(group[order], answers, x) for x in ("bits", "mine")]
        return out[0], out[1]

    def runs(self, pick: np.ndarray, width: int, groups: int) -> tuple[S.Runs, np.ndarray]:
        """Bands of the chosen lines in the form that superkmers.ask takes; `owner` is the line."""
        bands = dealt_bands(signatures([self.text[i] for i in pick.tolist()], width))
        name = bands.ravel()
        none = np.zeros(0, np.int64)
        return S.Runs(none, none, name, ((name >> U64(32)) % U64(groups)).astype(np.int64), np.repeat(pick, BANDS)), bands

    def candidates(self, bundle: int, width: int, groups: int, same: pa.Table, answers: pa.Table) -> pa.Table:
        """The represented lines with a shared band, with text and those bands, and the bare keys of lines that other bundles have too.

        One bundle represents a line, so that the bundle and the line's place there number it (`node`).
        """
        shared, mine = self.told_same(groups, same)
        pick = np.flatnonzero(mine)
        found, bands = self.runs(pick, width, groups)
        hot = S.told_names(found, answers).reshape(bands.shape)
        full = {int(pick[i]): bands[i][hot[i]].view(np.int64) for i in np.flatnonzero(hot.any(axis=1)).tolist()}
        rows = sorted(full.keys() | set(np.flatnonzero(shared).tolist()))
        at = [self.at[i] for i in rows]
        columns = [np.full(len(rows), bundle), [key_of(self.text[i]) for i in rows], [x for x, _ in at], [x for _, x in at], [bundle << 32 | i if i in full else None for i in rows], [self.text[i] if i in full else None for i in rows], [full.get(i) for i in rows]]
        return pa.table([pa.array(x, kind.type) for x, kind in zip(columns, CANDIDATE, strict=True)], schema=CANDIDATE)


def answer_same(table: pa.Table) -> pa.Table:
    """Which names of each bundle other bundles have too, and of which it is the first bundle."""
    each = [np.frombuffer(x.as_py(), np.uint64) for x in table["names"]]
    size = [len(x) for x in each]
    name, bundle = np.concatenate(each), np.repeat(table["b"].to_numpy(), size)
    order = np.lexsort((bundle, name))
    cuts = S.runs(name[order])
    many, first = np.empty(len(name), bool), np.zeros(len(name), bool)
    many[order] = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    first[order[cuts[:-1]]] = True
    ends = np.cumsum(size)[:-1]
    bits, mine = ([np.packbits(x).tobytes() for x in np.split(y, ends)] for y in (many, first))
    return pa.table([table["b"], table["g"], pa.chunked_array([pa.array(bits, pa.binary())]), pa.chunked_array([pa.array(mine, pa.binary())])], schema=SAME_ANSWER)


def key_of(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def shingles(line: str, width: int) -> set[str]:
    return {line[i : i + width] for i in range(len(line) - width + 1)} or {line}


def common(names: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many members the sets x[i] and y[i] have in common (names and offsets as line_sets gives them)."""
    out = np.zeros(len(x), np.int64)
    size = np.diff(first)
    weight = np.cumsum(size[x] + size[y])
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + AT_ONCE, side="right")))
        b = min(b, a + (1 << (64 - NAME_BITS)))
        sets = np.concatenate((x[a:b], y[a:b]))
        n = size[sets]
        at = np.arange(n.sum()) + np.repeat(first[sets] - (np.cumsum(n) - n), n)
        both = (np.repeat(np.tile(np.arange(b - a, dtype=U64), 2), n) << U64(NAME_BITS)) | names[at]
        both.sort()
        twice = both[1:][both[1:] == both[:-1]]
        out[a:b] = np.bincount((twice >> U64(NAME_BITS)).astype(np.int64), minlength=b - a)
        a = b
    return out


def may_fit(names: np.ndarray, first: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the sets x[i] and y[i] can be similar enough, as far as a bit for each of BITS remainders of names tells.

    A remainder that only one set has stands for a member, or more, that the other lacks.
    """
    size = np.diff(first)
    held = np.zeros((len(size), BITS // 8), np.uint8)
    for a in range(0, len(size), 2000):
        part = size[a : a + 2000]
        flags = np.zeros(len(part) * BITS, bool)
        flags[np.repeat(np.arange(len(part)) * BITS, part) + (names[first[a] : first[a + len(part)]] & U64(BITS - 1)).astype(np.int64)] = True
        held[a : a + 2000] = np.packbits(flags.reshape(len(part), BITS), axis=1)
    held = held.view(U64)
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), 2000):
        i, j = x[a : a + 2000], y[a : a + 2000]
        p, q = held[i], held[j]
        lacks = [np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64) for u, v in ((p, q), (q, p))]
        most = np.minimum(size[i] - lacks[0], size[j] - lacks[1])
        out[a : a + 2000] = 100 * most >= threshold * (size[i] + size[j] - most)
    return out


def joined(n: int, up: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n nodes, after more links; `up` keeps what was joined before."""

    def top(i: int) -> int:
        while (j := up[i]) != i:
            up[i] = i = up[j]
        return i

    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    out = np.array(up, np.int64)
    while not np.array_equal(out, more := out[out]):
        out = more
    return out


def small_links(members: pa.Table, texts: pa.Table, width: int, threshold: int) -> pa.Table:
    """Links among the lines of each bucket: members has bucket and node, texts has node and text.

    A pair whose lines other links join already is not tested; what comes back are stars around each component's first line.
    """
    texts = texts.sort_by("node")
    node = texts["node"].to_numpy()
    names, first = line_sets(texts["text"].to_pylist(), width)
    size = np.diff(first)
    bucket = members["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    own = np.searchsorted(node, members["node"].to_numpy())[order]
    cuts = S.runs(bucket[order])
    held = np.diff(cuts)
    pairs = [np.zeros(0, np.int64)]
    for k in np.unique(held).tolist():  # all buckets of one size at once
        block = own[cuts[:-1][held == k][:, None] + np.arange(k)]
        i, j = np.triu_indices(k, 1)
        low, high = np.minimum(block[:, i], block[:, j]), np.maximum(block[:, i], block[:, j])
        fits = 100 * np.minimum(size[low], size[high]) >= threshold * np.maximum(size[low], size[high])
        pairs.append(low[fits] * len(node) + high[fits])
    x, y = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(node)))
    fits = may_fit(names, first, x, y, threshold)
    x, y = x[fits], y[fits]
    up, root = list(range(len(node))), np.arange(len(node))
    for rounds_left in range(ROUNDS, -1, -1):
        # one pair for each line on the right, that with the first partner; in the end all that are left
        now = np.unique(y, return_index=True)[1] if rounds_left else np.arange(len(x))
        both = common(names, first, x[now], y[now])
        good = now[100 * both >= threshold * (size[x[now]] + size[y[now]] - both)]
        root = joined(len(node), up, x[good], y[good])
        left = np.ones(len(x), bool)
        left[now] = False
        left &= root[x] != root[y]
        x, y = x[left], y[left]
    away = np.flatnonzero(root != np.arange(len(node)))
    return pa.table([pa.array(node[root[away]], pa.int64()), pa.array(node[away], pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, lines: DataFrame, width: int, threshold: int) -> DataFrame:
    wide = pairs.join(lines.select(F.col("node").alias("a"), F.col("payload").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("payload").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            good, last, p = [], None, set()
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != last:
                    last, p = x, shingles(x, width)
                q = shingles(y, width)
                both = len(p & q)
                good.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return wide.mapInArrow(run, "a long, b long")


def linked(members: DataFrame, lines: DataFrame, width: int, threshold: int, chunk_mb: float = 2.0) -> DataFrame:
    """node, root for each line that has a link. members: bucket, node; lines: node, payload (the text)."""
    h = F.xxhash64("node")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("k"), F.min(h).alias("lo"), F.max(h).alias("hi"), F.bit_xor(h).alias("x")).filter("lo != hi")
    once = stored(buckets.groupBy("k", "lo", "hi", "x").agg(F.min("bucket").alias("_b")))
    n = parts(int(lines.agg(F.sum(F.octet_length("payload"))).first()[0] or 0), chunk_mb)
    dealt = once.filter(F.col("k") <= SMALL).select("_b", F.pmod(F.xxhash64("lo"), F.lit(n)).cast("int").alias("chunk"))
    placed = stored(members.join(dealt, F.col("bucket") == F.col("_b")).select("chunk", "bucket", "node"))
    texts = placed.select(F.col("chunk").alias("c"), F.col("node").alias("_n")).distinct().join(lines, F.col("node") == F.col("_n")).select("c", "node", F.col("payload").alias("text"))
    links = stored(placed.groupBy("chunk").cogroup(texts.groupBy("c")).applyInArrow(lambda held, text: small_links(held, text, width, threshold), "a long, b long"))
    large = stored(members.join(once.filter(F.col("k") > SMALL).select("_b"), F.col("bucket") == F.col("_b"), "left_semi"))
    if not large.isEmpty():
        sets = stored(lines.join(large.select(F.col("node").alias("_n")).distinct(), F.col("node") == F.col("_n"), "left_semi"))
        names = 8 * int(sets.agg(F.sum(F.char_length("payload"))).first()[0] or 0)
        roots = resolve(large, sets, lambda x: line_sets(x.to_pylist(), width), names, threshold, lambda pairs: confirm(pairs, sets, width, threshold))
        links = links.unionByName(roots.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    return components(links)


def dedup(docs: DataFrame, width: int = 8, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text", bundle_mb: float = 6.0) -> DataFrame:
    """doc_id, text (the kept lines), n_lines (with a word), n_removed for each row of `docs`."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = parts(text_bytes(docs), bundle_mb)
    docs = docs.withColumn("b", bundle_of(["doc_id", "text"], n))

    def asks(key, table, same):
        own = Lines(table)
        return S.ask(key[0].as_py(), own.runs(np.flatnonzero(own.told_same(n, same)[1]), width, n)[0])

    def narrow(key, table, answers):
        kind = answers["mine"].is_valid()  # one side of the cogroup has the answers of both rounds
        return Lines(table).candidates(key[0].as_py(), width, n, answers.filter(kind), answers.filter(pa.compute.invert(kind)))

    import pyarrow.compute  # noqa: F401

    bundles = docs.groupBy("b")
    same = bundles.applyInArrow(lambda key, table: Lines(table).ask_same(key[0].as_py(), n), S.ddl(SAME_ASK)).groupBy("g").applyInArrow(answer_same, S.ddl(SAME_ANSWER))
    told = bundles.cogroup(same.groupBy("b")).applyInArrow(asks, S.ddl(S.ASK)).groupBy("g").applyInArrow(S.answer, S.ddl(S.ANSWER))
    both = same.unionByName(told.withColumn("mine", F.lit(None).cast("binary")))
    found = stored(bundles.cogroup(both.groupBy("b")).applyInArrow(narrow, CANDIDATE_DDL))
    some = found.filter("text is not null")
    members = stored(some.select("node", F.explode("bands").alias("bucket")))
    roots = linked(members, some.select("node", F.col("text").alias("payload")), width, threshold)
    roots = some.select("key", F.col("node").alias("_n")).join(roots, F.col("node") == F.col("_n")).select(F.col("key").alias("_k"), "root")
    named = found.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("at"))
    named = stored(named.join(roots, F.col("key") == F.col("_k"), "left").select("key", "at", "root"))
    stays = named.filter("root is not null").groupBy(F.col("root").alias("_r")).agg(F.min("at").alias("first"))
    verdict = named.join(stays, F.col("root") == F.col("_r")).select(F.col("key").alias("_k"), "first")
    verdict = verdict.unionByName(named.filter("root is null").select(F.col("key").alias("_k"), F.col("at").alias("first")))
    told = found.select("b", "key", "doc_id", "line").join(verdict, F.col("key") == F.col("_k")).filter("first != struct(doc_id, line)")
    told = told.select("b", "key", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))

    def final(table, answers):
        told = dict(zip(answers["key"].to_pylist(), zip(answers["first_doc"].to_pylist(), answers["first_line"].to_pylist(), strict=True), strict=True))
        own = Lines(table)  # of a line that no answer names, the first occurrence of all is here
        stay = {line: told.get(key_of(line), at) for line, at in zip(own.text, own.at, strict=True)}
        texts, counts, removed = [], [], []
        ids = table["doc_id"].fill_null(S.NO_ID).to_pylist()
        for i, text in zip(ids, table["text"].to_pylist(), strict=True):
            kept, total, gone = [], 0, 0
            for at, line in enumerate((text or "").split("\n")):
                if line.strip(BLANK):
                    total += 1
                    if stay[line] != (i, at):
                        gone += 1
                        continue
                kept.append(line)
            texts.append(None if text is None else "\n".join(kept))
            counts.append(total)
            removed.append(gone)
        return pa.table([table["doc_id"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_lines", "n_removed"])

    return docs.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(final, "doc_id long, text string, n_lines long, n_removed long")
