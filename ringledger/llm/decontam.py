"""Operator 4, benchmark decontamination: Wu-Manber search for all windows of the benchmark at once.

Texts are lower-cased (A-Z), reduced to words and joined by one blank. A window is 13 consecutive words of an item, or
a shorter item as a whole. Windows are searched in the joined texts, with a blank at both ends so that words match as
a whole. Block shift tables skip impossible positions, buckets by the hash of the last block select windows, their
first bytes sort out most of them, and a direct comparison confirms. Many stretches of text are searched side by side,
each with a cursor of its own, so that a step is one array operation.

The benchmark reaches driver and workers in blocks of a fixed size, RESIDENT of them at a time. A larger benchmark takes
more passes over the documents: each stores the hits of its blocks, which are merged by row. Texts aren't shuffled by
find(), and by drop_contaminated() only after more than one pass.

Defined cases: a null text or one without words has no words, no hits and isn't contaminated; an item without words
has no window; equal items all count; an item without an id is named null; rows are judged one by one, so repeated
rows and ids don't matter; other columns are carried along by drop_contaminated(); an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import U64, raw_strings, slices, stored

#: Bytes of item text in one block of the benchmark.
BLOCK_BYTES = 4_000_000
#: Blocks that a worker holds at a time.
RESIDENT = 8
#: Window starts in one stretch of text, and bytes of text that are searched at once.
STRETCH, CHUNK = 1024, 8_000_000

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD = _FOLD.tobytes()


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words, on UTF-8: letters and digits of ASCII, and all beyond ASCII."""
    return raw.translate(FOLD).split()


def view(data: np.ndarray, width: int) -> np.ndarray:
    """The integer of `width` bytes at every position."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - width + 1),), f"<u{width}", data, strides=(1,))


class Tables:
    """Shift and bucket tables for patterns of similar length: slices of `text`, with the items they come from."""

    def __init__(self, text: bytes, start: np.ndarray, size: np.ndarray) -> None:
        self.text, self.start, self.size = text, start, size
        self.least = int(size.min())
        self.width = 8 if self.least >= 24 else 4 if self.least >= 6 else 2
        places = self.least - self.width + 1
        self.bits = int(np.clip(np.ceil(np.log2(16.0 * len(start) * min(places, 32))), 12, 22))
        blocks = view(np.frombuffer(text, np.uint8), self.width)
        self.shift = np.full(1 << self.bits, places, np.int32)
        for j in range(places):
            np.minimum.at(self.shift, self.hash(blocks[start + j]), places - 1 - j)
        last = self.hash(blocks[start + places - 1])
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.zeros((1 << self.bits) + 1, np.int32)
        np.add.at(self.bucket, last + 1, 1)
        self.bucket = np.cumsum(self.bucket, dtype=np.int32)
        self.head = blocks[start]

    def hash(self, block: np.ndarray) -> np.ndarray:
        return ((block.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def search(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(place in data, pattern) of every occurrence."""
        n = len(data) - self.least + 1
        if n <= 0:
            return
        blocks = view(np.frombuffer(data, np.uint8), self.width)
        cursor = np.arange(0, n, STRETCH)
        end = np.minimum(cursor + STRETCH, n)
        back = self.least - self.width
        found = []
        while len(cursor):
            slot = self.hash(blocks[cursor + back])
            step = self.shift[slot]
            stop = step == 0
            if stop.any():
                found.append((cursor[stop], slot[stop]))
            cursor = cursor + np.maximum(step, 1)
            live = cursor < end
            cursor, end = cursor[live], end[live]
        if not found:
            return
        place, slot = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        first, count = self.bucket[slot], self.bucket[slot + 1] - self.bucket[slot]
        for a in range(0, len(place), 100_000):  # bounded: windows of one bucket share a block
            p, f, c = (x[a : a + 100_000] for x in (place, first, count))
            each = np.repeat(p, c)
            which = self.order[np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(f, c)]
            same = np.flatnonzero(blocks[each] == self.head[which])
            for at, i in zip(each[same].tolist(), which[same].tolist(), strict=True):
                s, k = int(self.start[i]), int(self.size[i])
                if data[at : at + k] == self.text[s : s + k]:
                    yield at, i


class Matcher:
    """All windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        owners: dict[bytes, list[int]] = {}
        at: dict[bytes, tuple[int, int, int]] = {}
        text, offset = [], 0
        self.names = [name for name, _ in items]
        for number, (_, raw) in enumerate(items):
            words = words_of(raw)
            if not words:
                continue
            joined = b" " + b" ".join(words) + b" "
            starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).tolist()
            for i in range(max(1, len(words) - window + 1)):
                j = min(i + window, len(words))
                key = joined[starts[i] : starts[j] + 1]
                owners.setdefault(key, []).append(number)
                at.setdefault(key, (offset + starts[i], len(key), j - i))
            text.append(joined)
            offset += len(joined)
        blob = b"".join(text)
        keys = list(owners)
        start, size, self.n_words = (np.array([at[k][x] for k in keys], np.int64) for x in range(3))
        self.owners = [sorted(set(owners[k])) for k in keys]
        self.tables: list[tuple[np.ndarray, Tables]] = []
        kind = np.searchsorted([8, 24, 48, 96, 192], size, side="right")
        for k in np.unique(kind):
            pick = np.flatnonzero(kind == k)
            self.tables.append((pick, Tables(blob, start[pick], size[pick])))

    def search(self, data: bytes) -> Iterator[tuple[int, int]]:
        for pick, table in self.tables:
            for place, i in table.search(data):
                yield place, int(pick[i])


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Matcher]:
    """The benchmark as matchers of bounded size; the driver holds one block at a time."""
    items, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for row in rows.toLocalIterator():
        raw = row["t"].encode()
        items.append((row["i"], raw))
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield Matcher(items, window)
            items, size = [], 0
    if items:
        yield Matcher(items, window)


def scan(table: pa.Table, matchers: list[Matcher]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its number of words, the word spans of windows found in it (merged), and the items found."""
    flat, at = raw_strings(table)
    data, n = flat.tobytes(), len(at) - 1
    n_words, spans, items = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
    bounds, first = at.tolist(), 0
    while first < n:
        joined, ends, last, size = [], [0], first, 0
        while last < n and (last == first or size < CHUNK):
            words = words_of(data[bounds[last] : bounds[last + 1]])
            n_words[last] = len(words)
            joined.append(b" " + b" ".join(words) + b" " if words else b"")
            size += len(joined[-1])
            ends.append(size)
            last += 1
        buffer, found = b"".join(joined), {}
        for m, matcher in enumerate(matchers):
            for place, i in matcher.search(buffer):
                found.setdefault(int(np.searchsorted(ends, place, side="right")) - 1, []).append((place, m, i))
        for d, hits in found.items():
            blanks = np.flatnonzero(np.frombuffer(joined[d], np.uint8) == 0x20)
            names, cover = set(), []
            for place, m, i in sorted(hits):
                names.update(matchers[m].names[x] for x in matchers[m].owners[i])
                a = int(np.searchsorted(blanks, place - ends[d]))
                b = a + int(matchers[m].n_words[i])
                if cover and a <= cover[-1][1]:
                    cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
                else:
                    cover.append((a, b))
            spans[first + d], items[first + d] = cover, sorted(names)
        first = last
    return n_words, spans, items


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
HITS = "n_words long, n_hit long, spans array<struct<first: long, last: long>>, items array<string>, contaminated boolean"


def hits(n_words: list[int], spans: list, items: list) -> list[pa.Array]:
    """The columns of HITS; `spans` are pairs."""
    hit = [sum(b - a for a, b in x) for x in spans]
    bad = [is_contaminated(n, h) for n, h in zip(n_words, hit, strict=True)]
    return [pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], SPANS), pa.array(items, pa.list_(pa.string())), pa.array(bad, pa.bool_())]


def searched(slim: DataFrame, shared: list) -> DataFrame:
    """id, HITS for each row of slim (id, text) against the blocks `shared`."""

    def run(batches):
        matchers = [x.value for x in shared]
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), *hits(*scan(batch.column(1), matchers))], names=["id", "n_words", "n_hit", "spans", "items", "contaminated"])

    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, {HITS}")


def merged(parts: list[DataFrame]) -> DataFrame:
    """id, HITS of the rows with hits in any pass."""
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = rows.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def run(batches):
        for batch in batches:
            spans = []
            for each in batch.column(2).to_pylist():
                cover: list[tuple[int, int]] = []
                for a, b in ((x["first"], x["last"]) for x in each):
                    if cover and a <= cover[-1][1]:
                        cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
                    else:
                        cover.append((a, b))
                spans.append(cover)
            yield pa.record_batch([batch.column(0), *hits(batch.column(1).to_pylist(), spans, batch.column(3).to_pylist())], names=["id", "n_words", "n_hit", "spans", "items", "contaminated"])

    return rows.mapInArrow(run, f"id long, {HITS}")


def passes(slim: DataFrame, rest: Iterator[tuple[Matcher, ...]], first: list) -> tuple[DataFrame, DataFrame]:
    """id and n_words of all rows of slim (id: names rows with equal texts and ids alike), and HITS of those with hits."""
    sc, every, found, shared = slim.sparkSession.sparkContext, None, [], first
    while shared:
        out = stored(searched(slim, shared))
        every = out.select("id", "n_words") if every is None else every
        found.append(out.filter("n_hit > 0"))
        for x in shared:
            x.destroy()
        shared = [sc.broadcast(m) for m in next(rest, ())]
    return every, stored(merged(found))


def row_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_, text)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of `docs`: doc_id, n_words, n_hit, spans (hit words as [first, after last)), items, contaminated."""
    sc = docs.sparkSession.sparkContext
    rest = batched(blocks(benchmark, item_col, item_text_col, window), RESIDENT)
    first, second = ([sc.broadcast(m) for m in next(rest, ())] for _ in range(2))
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    if not second:
        return searched(docs.select(id_.alias("id"), text.alias("text")), first).withColumnRenamed("id", "doc_id")
    slim = docs.select(row_key(id_, text).alias("id"), text.alias("text"))
    every, found = passes(slim, iter([tuple(x.value for x in second), *rest]), first)
    ids = docs.select(id_.alias("doc_id"), row_key(id_, text).alias("_id"))
    words = every.dropDuplicates(["id"]).select("id", F.col("n_words").alias("_words"))
    rows = ids.join(words, F.col("_id") == F.col("id")).drop("id").join(found, F.col("_id") == F.col("id"), "left")
    none = [F.coalesce(c, F.lit(z)) for c, z in (("n_hit", 0), ("contaminated", False))]
    return rows.select("doc_id", F.col("_words").alias("n_words"), none[0].cast("long").alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<first: long, last: long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), none[1].alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't contaminated, unchanged."""
    sc = docs.sparkSession.sparkContext
    rest = batched(blocks(benchmark, item_col, item_text_col, window), RESIDENT)
    first, second = ([sc.broadcast(m) for m in next(rest, ())] for _ in range(2))
    if second:
        text = F.col(text_col)
        found = passes(docs.select(F.xxhash64(text).alias("id"), text.alias("text")), iter([tuple(x.value for x in second), *rest]), first)[1]
        bad = found.filter("contaminated").select("id")
        rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text).alias("key"))
        return rows.join(bad, F.col("key") == F.col("id"), "left_anti").select("row.*")
    at = docs.columns.index(text_col)

    def run(batches):
        matchers = [x.value for x in first]
        for batch in slices(batches):
            n_words, spans, _ = scan(batch.column(at), matchers)
            good = [not is_contaminated(n, sum(b - a for a, b in x)) for n, x in zip(n_words, spans, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
