"""Operator 11, ranked lexical search: TPUT (three phases, uniform threshold) over term-partitioned postings.

Scores are BM25 in whole numbers: a posting of term t in document d counts w(t) * s(t, d), with s = 10^9 tf div
(1000 tf + 8 m(d)) and m(d) = 100 - 90 + 90 n N div L. A document's score for a query sums the postings of the query's terms.

1. Every list (a term's postings, highest first) hands out its first `top` postings. Their sums are lower bounds of
   scores; the exact scores of the documents they name are looked up, and the top-th of them is the query's bound.
2. With m lists, a document that has less than bound / m in each of them stays below the bound. So every list hands out
   all postings that reach bound / m, uniformly. Sums over what came, plus what an unseen list can add at most, give
   lower and upper bounds; documents whose upper bound is below the bound, or below the top-th lower bound, are out.
3. The candidates' exact scores are looked up in the documents' counts; the best `top` stay. Nothing that could rank is
   dropped: all comparisons keep equal scores.

Scale. Texts are read once a block of queries (a few megabytes of query text, whose terms are bounded and broadcast): they become rows of
counts of query terms. Postings are packed by list and cut into chunks of bounded length, so that a term in a third of all
documents is many chunks. Partial sums of a query are dealt into slots by document, as many as its lists are long.

Defined cases: a null text has no terms; a query without terms, or whose terms no document holds, has no rows; repeated
documents and queries are rows of their own; a null doc_id comes last among equal scores; equal rows take the next
ranks; other columns are ignored; no documents or no queries give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringledger.llm.common import mix, raw_strings, runs, slices, stored
from ringledger.llm.simhash import stretches

#: Bytes of query text in a block, about.
BLOCK_BYTES = 4_000_000
#: Postings of a chunk of a list, and of a task, about.
CHUNK, TASK = 200_000, 1_000_000
ONE = 10**9
#: ASCII letters and digits and everything beyond ASCII make terms; A-Z become a-z, the rest blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PAIRS = "item int, key long, score long"


def counts_of(text: bytes) -> tuple[Counter, int]:
    """How often each term occurs, and the number of all."""
    found, n = Counter(), 0
    for words in stretches(text.translate(TERM_BYTES)):
        found.update(words)
        n += len(words)
    return found, n


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """key (of the row), doc_id, n (terms of the text), terms, tf (those in the vocabulary) of documents with a term."""

    def run(batches):
        for batch in slices(batches):
            flat, at = raw_strings(batch.column(2))
            known = vocabulary.value
            size, terms, tf, cuts = [], [], [], [0]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found, n = counts_of(flat[a:b].tobytes())
                size.append(n)
                hit = known.keys() & found.keys()
                terms.extend([known[w] for w in hit])
                tf.extend([found[w] for w in hit])
                cuts.append(len(terms))
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size, pa.int64()), *lists], names=["key", "doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "key long, doc_id long, n long, terms array<int>, tf array<int>").filter("n > 0")


class Law:
    """What the score of a posting needs: the number of documents and of all terms, and a weight for each query term."""

    def __init__(self, documents: int, terms: int, df: np.ndarray):
        self.documents, self.terms = documents, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)

    def parts(self, tf: np.ndarray, n: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """s for postings with tf, of documents with n terms; owner is the place of a posting's document in n."""
        m = np.array([10 + (90 * x * self.documents) // self.terms for x in n.tolist()], np.int64)
        return (ONE * tf) // (1000 * tf + 8 * m[owner])


def flattened(batch: pa.RecordBatch, terms: int, tf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and tf of all rows one after the other, and the place of their rows."""
    lists = batch.column(terms)
    owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    return lists.flatten().to_numpy().astype(np.int64), batch.column(tf).flatten().to_numpy().astype(np.int64), owner


def postings(documents: DataFrame, law: Law, df: np.ndarray) -> DataFrame:
    """term, chunk, keys (packed longs), parts (packed ints): lists with the highest s first, cut into chunks."""
    chunks = np.maximum(1, -(-df // CHUNK))
    tasks = int(max(1, -(-int(df.sum()) // TASK)))

    def deal(batches):
        for batch in batches:
            term, tf, owner = flattened(batch, 2, 3)
            keys, s = batch.column(0).to_numpy(), law.parts(tf, batch.column(1).to_numpy(), owner)
            some = np.flatnonzero((s > 0) & (law.weight[term] > 0))
            some = some[np.argsort(term[some], kind="stable")]
            cuts = runs(term[some])
            if not len(some):
                continue
            begin = term[some[cuts[:-1]]]
            chunk = (mix(np.full(1, keys[0], np.uint64))[0] % chunks[begin].astype(np.uint64)).astype(np.int64)
            task = (mix(((begin << 24) + chunk).astype(np.uint64)) % np.uint64(tasks)).astype(np.int64)
            packed = [[x[some[a:b]].astype(kind).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] for x, kind in ((keys[owner], np.int64), (s, np.int32))]
            yield pa.record_batch([pa.array(task, pa.int32()), pa.array(begin, pa.int32()), pa.array(chunk, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["task", "term", "chunk", "keys", "parts"])

    def lists(table):
        term, chunk = table["term"].to_numpy().astype(np.int64), table["chunk"].to_numpy().astype(np.int64)
        flat, at = raw_strings(table["keys"])
        keys, s = flat.view(np.int64), raw_strings(table["parts"])[0].view(np.int32)
        name = np.repeat((term << 24) + chunk, np.diff(at) // 8)
        order = np.lexsort((keys, -s, name))
        cuts = runs(name[order])
        if not len(order):
            return pa.table([pa.array([], x) for x in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], names=["term", "chunk", "keys", "parts"])
        first = name[order[cuts[:-1]]]
        packed = [[x[order[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] for x in (keys, s)]
        return pa.table([pa.array(first >> 24, pa.int32()), pa.array(first & (2**24 - 1), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["term", "chunk", "keys", "parts"])

    dealt = documents.select("key", "n", "terms", "tf").mapInArrow(deal, "task int, term int, chunk int, keys binary, parts binary")
    return dealt.groupBy("task").applyInArrow(lists, "term int, chunk int, keys binary, parts binary")


def heads(lists: DataFrame, top: int) -> DataFrame:
    """term, key: the first `top` postings of each list."""

    def run(batches):
        for batch in batches:
            keys, s = ([np.frombuffer(x.as_buffer(), kind)[:top] for x in batch.column(i)] for i, kind in ((1, np.int64), (2, np.int32)))
            size = [len(x) for x in keys]
            if len(size):
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), size), pa.int32()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(s))], names=["term", "key", "s"])

    each = lists.select("term", "keys", "parts").mapInArrow(run, "term int, key long, s int")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("s").desc(), "key"))
    return each.withColumn("place", place).filter(F.col("place") <= top).select("term", "key")


class Queries:
    """The terms of a block of queries: for each term, the queries that have it."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray):
        some = weight[term] > 0
        item, term = item[some], term[some]
        order = np.lexsort((item, term))
        self.item, self.term = item[order], term[order]
        self.first = np.searchsorted(self.term, np.arange(len(weight) + 1))
        self.lists = np.bincount(item, minlength=int(item.max(initial=-1)) + 1)
        self.known = np.unique(item * len(weight) + term)
        self.width = len(weight)

    def has(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the query has the term, for each pair."""
        wanted = item * self.width + term
        if not len(self.known):
            return np.zeros(len(wanted), bool)
        return self.known[np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)] == wanted


def exact(pairs: DataFrame, documents: DataFrame, queries: Queries, law: Law) -> DataFrame:
    """item, key, doc_id, score of distinct pairs (item, key), looked up in the documents' counts."""

    def run(batches):
        for batch in slices(batches, 2000):
            item, n = batch.column(0).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            term, tf, owner = flattened(batch, 4, 5)
            hit = np.flatnonzero(queries.has(item[owner], term))
            score = np.zeros(len(item), np.int64)
            np.add.at(score, owner[hit], law.weight[term[hit]] * law.parts(tf, n, owner)[hit])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(score)], names=["item", "key", "doc_id", "score"])

    both = pairs.select("item", F.col("key").alias("_k")).join(documents, F.col("_k") == F.col("key"))
    return both.select("item", "key", "doc_id", "n", "terms", "tf").mapInArrow(run, "item int, key long, doc_id long, score long")


def best(scored: DataFrame, top: int, *order: str) -> DataFrame:
    """Adds rank; the first `top` rows of each item, highest score first."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), *(F.col(c).asc_nulls_last() for c in order)))
    return scored.withColumn("rank", place).filter(F.col("rank") <= top)


def bounds(scored: DataFrame, top: int, items: int) -> np.ndarray:
    """The top-th highest score of each item, 0 if there are fewer."""
    out = np.zeros(items, np.int64)
    for row in best(scored, top, "key").filter(F.col("rank") == top).select("item", "score").collect():  # a row a query of the block
        out[row["item"]] = row["score"]
    return out


def fetched(lists: DataFrame, queries: Queries, law: Law, bound: np.ndarray, df: np.ndarray) -> DataFrame:
    """item, key, low, high: bounds of the scores of all documents that a list hands out and that may reach the bound."""
    least = -(-bound // np.maximum(1, queries.lists))  # postings from here on are handed out
    # an unseen posting is below that, and no list has more than its weight times a million
    ceiling = np.minimum(law.weight[queries.term] * 10**6, np.maximum(0, least[queries.item] - 1))
    whole = np.bincount(queries.item, ceiling, minlength=len(bound)).astype(np.int64)
    length = np.bincount(queries.item, df[queries.term], minlength=len(bound))
    slots = np.maximum(1, np.ceil(length / TASK)).astype(np.int64)
    tasks = int(max(1, math.ceil(length.sum() / TASK)))

    def deal(batches):
        for batch in slices(batches, 100):
            out = []
            for term, k, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                a, b = queries.first[term], queries.first[term + 1]
                if a == b:
                    continue
                keys = np.frombuffer(k.as_buffer(), np.int64)
                score = law.weight[term] * np.frombuffer(s.as_buffer(), np.int32).astype(np.int64)
                ends = np.searchsorted(-score, -least[queries.item[a:b]], side="right")
                spread = mix(keys.view(np.uint64))
                for item, end, most in zip(queries.item[a:b].tolist(), ends.tolist(), ceiling[a:b].tolist(), strict=True):
                    if not end:
                        continue
                    n = slots[item]
                    slot = (spread[:end] % np.uint64(n)).astype(np.int64) if n > 1 else None
                    for x in range(n) if n > 1 else (0,):
                        own = slice(0, end) if slot is None else np.flatnonzero(slot == x)
                        part = keys[:end][own]
                        if len(part):
                            out.append(((item * 7919 + x) % tasks, item, x, most, part.tobytes(), score[:end][own].tobytes()))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["task", "item", "slot", "most", "keys", "scores"])

    def summed(table):
        item, slot = table["item"].to_numpy().astype(np.int64), table["slot"].to_numpy()
        order = np.lexsort((slot, item))
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(item[order]) != 0) | (np.diff(slot[order]) != 0)) + 1, [len(order)])) if len(order) else [0]
        keys, scores = table["keys"].combine_chunks(), table["scores"].combine_chunks()
        most = table["most"].to_numpy()
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[a:b].tolist()
            key = np.concatenate([np.frombuffer(keys[i].as_buffer(), np.int64) for i in rows])
            score = np.concatenate([np.frombuffer(scores[i].as_buffer(), np.int64) for i in rows])
            seen = np.repeat(most[rows], [len(keys[i].as_buffer()) // 8 for i in rows])
            by = np.argsort(key, kind="stable")
            at = runs(key[by])[:-1]
            low = np.add.reduceat(score[by], at)
            high = low + whole[item[rows[0]]] - np.add.reduceat(seen[by], at)
            good = high >= bound[item[rows[0]]]
            parts.append((np.full(int(good.sum()), item[rows[0]]), key[by][at][good], low[good], high[good]))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["item", "key", "low", "high"])

    dealt = lists.select("term", "keys", "parts").mapInArrow(deal, "task int, item int, slot int, most long, keys binary, scores binary")
    return dealt.groupBy("task").applyInArrow(summed, "item int, key long, low long, high long")


def block_search(docs: DataFrame, texts: list[bytes], top: int) -> DataFrame:
    """item (place in texts), doc_id, score, rank of a block of queries."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    item, term = [], []
    for i, text in enumerate(texts):
        for word in counts_of(text)[0]:
            item.append(i)
            term.append(vocabulary.setdefault(word, len(vocabulary)))
    known = spark.sparkContext.broadcast(vocabulary)  # bounded by the block's text
    documents = stored(counted(docs, known))
    total = documents.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for row in documents.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[row["term"]] = row["count"]
    law = Law(int(total[0]), int(total[1] or 1), df)
    queries = Queries(np.array(item, np.int64), np.array(term, np.int64), law.weight)
    lists = stored(postings(documents, law, df))
    pairs = spark.createDataFrame(list(zip(queries.item.tolist(), queries.term.tolist(), strict=True)), "item int, _t int")
    first = heads(lists, top).join(pairs, F.col("term") == F.col("_t")).select("item", "key").distinct()
    bound = bounds(exact(first, documents, queries, law), top, len(queries.lists))
    found = stored(fetched(lists, queries, law, bound, df))
    again = bounds(found.select("item", "key", F.col("low").alias("score")), top, len(bound))
    least = spark.createDataFrame(list(enumerate(np.maximum(bound, again).tolist())), "_i int, bound long")
    candidates = found.join(F.broadcast(least), F.col("item") == F.col("_i")).filter(F.col("high") >= F.col("bound")).select("item", "key")
    return best(exact(candidates, documents, queries, law).filter("score > 0"), top, "doc_id", "key").select("item", "doc_id", "score", "rank")


def search(docs: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents for each row of `queries`."""
    spark = docs.sparkSession
    slim = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(F.col(item_col).alias("item_id"), F.col(query_col).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    kind = dict(asked.dtypes)["item_id"]
    out = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        texts = [(r["text"] or "").encode() for r in rows]
        named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"_i int, item_id {kind}")
        found = block_search(slim, texts, top).join(F.broadcast(named), F.col("item") == F.col("_i"))
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
