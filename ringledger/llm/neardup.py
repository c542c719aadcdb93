"""Operator 9, near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, stars.

A document's set holds its distinct shingles of `width` words (ASCII lower case); with fewer words, the whole sequence.
Documents are linked if their sets' Jaccard similarity is at least `threshold` percent. Equal sets are merged first and
stand for all their rows. Buckets of equal bands give star-shaped candidate pairs (stars.py), every candidate link is
confirmed on the full sets, and components are found by star contraction.

Recall: 32 bands of 5 bins miss a pair at exactly 80 % with a chance of 3e-6, less above.

Sets are the nodes of all links; a component's id is the smallest doc_id of the rows that hold one of its sets. Results go
back to the rows by set. A set with a thousandth of all rows or more is told by broadcast (a thousand sets at most), so
that no task gets all copies of a text.

Defined cases: a document without words has an empty set and is its own component; equal sets are linked; rows are
judged by their text, so that two rows of one id may be in different components; a row without an id links others, is
never kept for a component with an id, and without any id in its component it has no component and is kept;
other columns are ignored; no rows give no rows. drop_near_duplicates keeps one row of each component, also of one
without an id, and all rows without id and words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.llm import minhash
from ringledger.llm.common import U64, WORD, mix, raw_strings, slices, stored
from ringledger.llm.stars import resolve

ROWS, BANDS = 5, 32
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_sets(table: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle names of every text, one after the other, and the n + 1 offsets."""
    flat, at = raw_strings(table)
    data = flat.tobytes().translate(LOWER)
    each, first = [np.zeros(0, U64)], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        words = data[a:b].split()
        n = len(words)
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, n)
        take = min(n, width)
        out = np.full(max(0, n - width + 1) if n >= width else int(n > 0), take, U64)
        for j in range(take):
            out = mix(out * U64(0x9E3779B97F4A7C15) + names[j : j + len(out)])
        out = np.unique(out)
        each.append(out)
        first.append(first[-1] + len(out))
    return np.concatenate(each), np.array(first, np.int64)


def packed_sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Members and offsets of packed sets."""
    flat, at = raw_strings(column)
    return np.frombuffer(flat.tobytes(), U64), at // 8


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, rid, n_shingles, set_key (128-bit name of the set; null if empty), bands of docs (doc_id, rid, text)."""

    def run(batches):
        for batch in slices(batches):
            members, first = shingle_sets(batch.column(2), width)
            cuts = first.tolist()
            keys = [xxhash.xxh3_128_digest(members[a:b].tobytes()) if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            band = minhash.bands(minhash.signatures(members, first, ROWS * BANDS), ROWS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(band.ravel(), pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(first), pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "rid", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, rid long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, members (packed sorted names) for the nodes (node, rid): the set of the row rid."""
    # always by shuffle: the list of nodes grows with the input, and texts are dealt out once at any size
    wanted = docs.select("rid", "text").join(nodes.select(F.col("rid").alias("_r")).hint("merge"), F.col("rid") == F.col("_r"), "left_semi").select("text")

    def run(batches):
        for batch in slices(batches):
            members, first = shingle_sets(batch.column(0), width)
            cuts = first.tolist()
            packed = [members[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary()), pa.array(packed, pa.binary())], names=["node", "members"])

    made = wanted.mapInArrow(run, "node binary, members binary")
    return made.join(nodes.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    wide = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    wide = wide.filter(F.lit(100) * F.least(F.octet_length("x"), F.octet_length("y")) >= F.lit(threshold) * F.greatest(F.octet_length("x"), F.octet_length("y")))

    def run(batches):
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return wide.mapInArrow(run, "a binary, b binary")


def rooted(sketched: DataFrame, slim: DataFrame, width: int, threshold: int) -> DataFrame:
    """set_key, k (rows), least (smallest doc_id), root (a name of the component) of each set."""
    nodes = sketched.filter("set_key is not null").groupBy("set_key").agg(F.min("rid").alias("rid"), F.first("bands").alias("bands"), F.min("doc_id").alias("least"), F.count("*").alias("k"))
    members = nodes.select(F.col("set_key").alias("node"), "rid", F.explode("bands").alias("bucket"))
    h = F.xxhash64("node")
    crowded = members.groupBy("bucket").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo != hi").select(F.col("bucket").alias("_b"))
    members = stored(members.join(crowded, F.col("bucket") == F.col("_b"), "left_semi"))
    sets = stored(full_sets(slim, members.select("node", "rid").distinct(), width))
    payload = sets.withColumnRenamed("members", "payload")
    size = int(sets.agg(F.sum(F.octet_length("members"))).first()[0] or 0)
    roots = resolve(members.select("node", "bucket"), payload, packed_sets, size, threshold, lambda pairs: confirm(pairs, sets, threshold))
    return nodes.select("set_key", "k", "least").join(roots.select(F.col("node").alias("_n"), "root"), F.col("set_key") == F.col("_n"), "left").select("set_key", "k", "least", F.coalesce("root", "set_key").alias("root"))


def named(docs: DataFrame, width: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rid, n_shingles, component_id (null without an id) and root (null for an empty set) for each row of `docs`."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    sketched = stored(sketches(slim, width))
    each = stored(rooted(sketched, slim, width, threshold))
    least = each.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("_r"), "component_id")
    sets = stored(each.join(least, F.col("root") == F.col("_r")).select(F.col("set_key").alias("_k"), "k", "root", "component_id"))
    rows = sketched.drop("bands")
    out = ("doc_id", "rid", "n_shingles", "component_id", "root")
    most = F.col("k") * 1000 >= sketched.count()  # of a thousand sets at most
    same = F.col("set_key") == F.col("_k")
    hot = F.broadcast(sets.filter(most))
    copies = rows.join(hot, same).select(*out)
    others = rows.filter("set_key is not null").join(F.broadcast(sets.filter(most).select("_k")), same, "left_anti").join(sets.filter(~most), same).select(*out)
    empty = rows.filter("set_key is null").select("doc_id", "rid", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("root"))
    return copies.unionByName(others).unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`."""
    component = F.col("component_id")
    kept = F.when(component.isNull(), True).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return named(docs, width, threshold, id_col, text_col).select("doc_id", "n_shingles", component, kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component, unchanged: of its first id, if it has one; equal rows count once."""
    found = named(docs, width, threshold, id_col, text_col)
    first = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("_keep"))
    keep = first.select("_keep").unionByName(found.filter("root is null").select(F.col("rid").alias("_keep")).distinct())
    free = F.col(id_col).isNull() & ~F.coalesce(F.col(text_col), F.lit("")).rlike(WORD)
    rows = docs.filter(~free).select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("rid")).join(keep, F.col("rid") == F.col("_keep"), "left_semi")
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("rid").orderBy(F.xxhash64("row")))).filter("n = 1").select("row.*")
    return one.unionByName(docs.filter(free))
