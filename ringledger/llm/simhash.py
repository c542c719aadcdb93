"""Operator 13, near-duplicate documents by SimHash: BK-trees over shards of fingerprints.

A document's fingerprint has a bit set where more than half of the 64-bit hashes of its three-word shingles, repeats
included, have it. Fingerprints link at `radius` or fewer differing bits; components of links are the groups.

Shards. Only distinct fingerprints are searched. Of radius + 1 parts of the bits, two linked fingerprints agree in one at
least, so each fingerprint is placed in radius + 1 shards, named by a mask and the bits under it. A shard with more than
`most` fingerprints is dealt again by the bits that are left, and so on: as the bits run out, no shard stays larger,
however many near copies a text has. Every link lies within some shard.

Trees. A shard's BK-tree hangs each fingerprint below the first one that stands where it would go; a child's key is its
Hamming distance to its parent. A search that measures d at a node follows only edges with keys from d - radius to
d + radius (the triangle inequality). A tree travels to the task that holds all queries of its shard: as fingerprints of
all documents may not pass the driver, trees are not sent with the driver's broadcast. A tree gives a spanning forest of
the links of its shard, at most one link a fingerprint, not all pairs.

Defined cases: a null text has no words; no words: fingerprint zero, linked like any other; fewer than three words: the
whole sequence is the one shingle; rows without an id link others, and have no component if none of its rows has an id;
rows are judged by their text, so repeated ids may lie in several components; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import U64, raw_strings, runs, slices, stored
from ringledger.llm.components import components
from ringledger.llm.neardup import LOWER

SEED = 42
#: Fingerprints in a shard at most.
MOST = 20_000
#: Bytes of text whose words are held at once.
STRETCH = 1 << 20
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACE = np.arange(8, dtype=np.int64) * 256


def stretches(data: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text, a stretch of about `size` bytes at a time."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            head = data[at:end].split()
            broken = len(head[-1]) if head and not data[end - 1 : end].isspace() else 0
            while broken >= size:  # a word longer than a stretch
                size *= 2
                head = data[at : at + size].split()
                end = min(at + size, len(data))
                broken = len(head[-1]) if head and end < len(data) and not data[end - 1 : end].isspace() else 0
            if broken:
                head.pop()
            yield head
            at = end - broken
        else:
            yield data[at:].split()
            return


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of `width` words joined by a space; of the whole sequence if it is shorter; none for no words."""
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], U64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: len(words) - width + 1].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, end[width - 1 :].tolist(), strict=True)), U64, len(start))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, from the lowest."""
    each = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + PLACE).ravel(), minlength=2048)
    return (each.reshape(8, 256) @ BITS).ravel()


def fingerprint(data: bytes, width: int = 3) -> int:
    """The fingerprint of a text in UTF-8."""
    total, count, kept = np.zeros(64, np.int64), 0, []
    for words in stretches(data.translate(LOWER)):
        words = kept + words
        if len(words) >= width:
            hashes = shingle_hashes(words, width)
            total += bit_counts(hashes)
            count += len(hashes)
            kept = words[len(words) - width + 1 :]
        else:
            kept = words
    if not count and kept:
        total, count = bit_counts(shingle_hashes(kept, width)), 1
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""

    def run(batches):
        for batch in slices(batches):
            flat, at = raw_strings(batch.column(1))
            found = [fingerprint(flat[a:b].tobytes(), width) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, U64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks_below(mask: int, radius: int) -> list[int]:
    """`mask` with each of radius + 1 parts of the bits that it leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def sharded(distinct: DataFrame, radius: int, most: int) -> DataFrame:
    """mask, value, fp: the shards with two fingerprints or more and at most `most` (2 ** radius at least, which bits are left to tell apart)."""
    most = max(most, 1 << radius)  # with no more free bits than the radius, parts no longer tell links
    wide = [0]
    placed = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    done = None
    while True:
        below = [(signed(m), [signed(x) for x in masks_below(m, radius)]) for m in wide]
        finer = F.coalesce(*(F.when(F.col("mask") == m, F.array(*(F.lit(x).cast("long") for x in to))) for m, to in below))
        placed = placed.select(F.explode(finer).alias("mask"), "fp")
        placed = stored(placed.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp").distinct())
        size = placed.groupBy("mask", "value").count().filter("count > 1").select(F.col("mask").alias("_m"), F.col("value").alias("_v"), F.col("count").alias("size"))
        held = stored(placed.join(size, (F.col("mask") == F.col("_m")) & (F.col("value") == F.col("_v"))).select("mask", "value", "fp", (F.col("size") > most).alias("over")))
        part = held.filter(~F.col("over")).drop("over")
        done = part if done is None else done.unionByName(part)
        wide = sorted({x % (1 << 64) for _, to in below for x in to})
        placed = held.filter("over").select("mask", "fp")
        if placed.isEmpty():
            return done


class Tree:
    """A BK-tree over distinct fingerprints: node i has value[i]; its children are child[i], {distance to node i: node}."""

    def __init__(self, value: np.ndarray):
        self.value, self.child = value, [{} for _ in range(len(value))]
        todo = [np.arange(len(value))]
        while todo:
            rows = todo.pop()  # the first is a node, the others hang below it
            top, rest = rows[0], rows[1:]
            apart = np.bitwise_count(value[rest] ^ value[top])
            order = np.argsort(apart, kind="stable")
            cuts = runs(apart[order])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group = rest[order[a:b]]
                self.child[top][int(apart[order[a]])] = int(group[0])
                if len(group) > 1:
                    todo.append(group)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, places in `queries`) for all queries within the radius of a node."""
        todo = [(0, np.arange(len(queries)))] if len(self.value) else []
        while todo:
            node, asked = todo.pop()
            apart = np.bitwise_count(queries[asked] ^ self.value[node]).astype(np.int64)
            near = asked[apart <= radius]
            if len(near):
                yield node, near
            for key, below in self.child[node].items():
                follow = asked[np.abs(apart - key) <= radius]
                if len(follow):
                    todo.append((below, follow))


def forest(value: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what all links within the radius connect, at most one for each fingerprint but one."""
    parent = list(range(len(value)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for node, near in Tree(value).search(value, radius):
        for other in near.tolist():
            x, y = top(node), top(other)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((node, other))
    return out


def links(distinct: DataFrame, radius: int = 2, most: int = MOST) -> DataFrame:
    """a, b: links that connect the distinct fingerprints (fp) as all links do."""
    shards = sharded(distinct, radius, most)
    tasks = max(1, -(-shards.count() // MOST))

    def search(table):
        mask, value, fp = (table[c].to_numpy() for c in ("mask", "value", "fp"))
        order = np.lexsort((fp, value, mask))
        mask, value, fp = mask[order], value[order], fp[order]
        cuts = np.concatenate(([0], np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1, [len(fp)]))
        a, b = [], []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = fp[x:y]
            for i, j in forest(own.view(U64), radius):
                a.append(own[i])
                b.append(own[j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = shards.withColumn("task", F.pmod(F.xxhash64("mask", "value"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInArrow(search, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fp (signed long), component_id for each row of `docs`."""
    rows = stored(fingerprints(docs, width, id_col, text_col))
    each = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")))
    roots = components(stored(links(each.select("fp"), radius, most)))
    named = stored(each.join(roots.select(F.col("node").alias("_n"), "root"), F.col("fp") == F.col("_n"), "left").select("fp", "k", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("_r"), "component_id")
    told = stored(named.join(least, F.col("root") == F.col("_r")).select(F.col("fp").alias("_f"), "k", "component_id"))
    hot = F.col("k") * 1000 >= rows.count()  # of a thousand fingerprints at most
    same = F.col("fp") == F.col("_f")
    frequent = F.broadcast(told.filter(hot))
    copies = rows.join(frequent, same).select("doc_id", "fp", "component_id")
    others = rows.join(F.broadcast(told.filter(hot).select("_f")), same, "left_anti").join(told.filter(~hot), same).select("doc_id", "fp", "component_id")
    return copies.unionByName(others)
