"""Operator 6, language-model scoring by subword lattices.

The model is a unigram model over the pieces of an existing subword vocabulary (a SentencePiece file, its path a
parameter). Its scores are piece probabilities, estimated from the training documents: every distinct word is cut by
the existing tokenizer and counts as often as it occurs. A word's probability is the sum over all its segmentations
into pieces, by forward recursion in log space; a character that no piece covers counts as its bytes. A text's log10
probability is the sum over its words and one end. Words are lower-cased (A-Z).

Every distinct word is counted and scored once for the whole corpus, in a group of words (by hash); bundles of
documents send their distinct words with training counts to the groups and get counts and scores back.

Only the vocabulary (a fixed number of pieces), totals and the piece counts reach the driver.

Defined cases: a null or blank text has one token, the end; a row without an id counts as the id '' for the held-out
rule; repeated rows count as often as they occur; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import U64, bundle_of, parts, raw_strings, runs, split_blobs, stored, text_bytes
from ringledger.llm.neardup import LOWER

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SMOOTH = 0.1

ASK = "g int, b int, words binary, counts binary"
GROUP = "g int, words binary, counts binary, bundles array<int>, places array<binary>, total long, distinct long, pieces array<int>, piece_counts array<long>"
ANSWER = "b int, g int, counts binary, scores binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(id_col: str) -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 10 == 0


class Bundle:
    """Distinct words of a bundle in order of (group, word), and each text's words as places in that list."""

    def __init__(self, table: pa.Table, groups: int) -> None:
        flat, at = raw_strings(table["text"])
        data = flat.tobytes().translate(LOWER)
        words: list[bytes] = []
        first = [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            words += data[a:b].split()
            first.append(len(words))
        distinct = list(set(words))
        group = (np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct)) % U64(groups)).astype(np.int64).tolist()
        ordered = sorted(zip(group, distinct, strict=True))
        self.words = [w for _, w in ordered]
        self.group = np.array([g for g, _ in ordered], np.int64)
        index = dict(zip(self.words, range(len(ordered)), strict=True))
        self.place = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.first = np.array(first, np.int64)


def asks(key: tuple, table: pa.Table, groups: int) -> pa.Table:
    own = Bundle(table, groups)
    train = np.repeat(~np.array(table["held_out"].to_pylist(), bool), np.diff(own.first))
    counts = np.bincount(own.place[train], minlength=len(own.words)).astype(np.uint32)
    cuts = runs(own.group)
    blobs = [b"\n".join(own.words[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    heads = own.group[cuts[:-1]]
    return pa.table([pa.array(heads, pa.int32()), pa.array(np.full(len(heads), key[0].as_py()), pa.int32()), pa.array(blobs, pa.binary()), pa.array(split_blobs(counts, cuts), pa.binary())], names=["g", "b", "words", "counts"])


class Pieces:
    """The existing vocabulary: piece texts, byte pieces, and the tokenizer that cuts words."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.cutter.get_piece_size()
        self.size = n
        self.byte = np.full(256, -1)
        self.number: dict[str, int] = {}
        for i in range(n):
            if self.cutter.is_byte(i):
                self.byte[int(self.cutter.id_to_piece(i)[3:5], 16)] = i
            elif not (self.cutter.is_control(i) or self.cutter.is_unknown(i)):
                self.number[self.cutter.id_to_piece(i)] = i
        self.longest = max(map(len, self.number))

    def count(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the words, cut by the existing tokenizer."""
        out = np.zeros(self.size, np.int64)
        for a in range(0, len(words), 20_000):
            cut = self.cutter.encode(words[a : a + 20_000], num_threads=1)
            sizes = np.fromiter(map(len, cut), np.int64, len(cut))
            flat = np.fromiter((x for y in cut for x in y), np.int64, int(sizes.sum()))
            np.add.at(out, flat, np.repeat(times[a : a + 20_000], sizes))
        return out


class Lattice:
    """Marginal log10 probability of words under piece scores."""

    def __init__(self, pieces: Pieces, scores: np.ndarray) -> None:
        self.longest = pieces.longest
        self.score = {p: float(scores[i]) for p, i in pieces.number.items()}
        least = float(scores.min())
        self.byte = [float(scores[i]) if i >= 0 else least for i in pieces.byte.tolist()]
        # an open-addressing table of piece hashes, for many words at once
        names = list(self.score)
        points = [np.array([ord(c) for c in p], U64) for p in names]
        hashes = np.array([self._hash(p) for p in points], U64)
        self.mask = (1 << max(8, (8 * len(names)).bit_length())) - 1
        self.slot = np.zeros(self.mask + 1, U64)
        self.value = np.full(self.mask + 1, -np.inf)
        self.probes = 1
        used = set()
        for h, name in zip(hashes.tolist(), names, strict=True):
            at, tries = (h >> 20) & self.mask, 1
            while at in used:
                at, tries = (at + 1) & self.mask, tries + 1
            used.add(at)
            self.probes = max(self.probes, tries)
            self.slot[at], self.value[at] = h, self.score[name]

    @staticmethod
    def _hash(points: np.ndarray) -> U64:
        h = U64(0)
        with np.errstate(over="ignore"):
            for p in points:
                h = (h + p + U64(1)) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(31)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = ((h >> U64(20)) & U64(self.mask)).astype(np.int64)
        out = np.full(len(h), -np.inf)
        for _ in range(self.probes):
            same = self.slot[at] == h
            out[same] = self.value[at][same]
            at = (at + 1) & self.mask
        return out

    def fallback(self, c: str) -> float:
        return sum(self.byte[x] for x in c.encode())

    def one(self, word: str) -> float:
        text = MARK + word
        log = [0.0]
        for j in range(1, len(text) + 1):
            terms = [log[i] + s for i in range(max(0, j - self.longest), j) if (s := self.score.get(text[i:j])) is not None]
            if text[j - 1] not in self.score:
                terms.append(log[j - 1] + self.fallback(text[j - 1]))
            top = max(terms, default=-np.inf)
            log.append(top + np.log10(sum(10.0 ** (t - top) for t in terms)) if terms else -np.inf)
        return float(log[-1])

    def many(self, words: list[str]) -> np.ndarray:
        """Forward recursion over all words of a length side by side."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            pick = np.flatnonzero(size == n)
            if len(pick) < 16:
                out[pick] = [self.one(words[i]) for i in pick.tolist()]
                continue
            for a in range(0, len(pick), 20_000):
                part = pick[a : a + 20_000]
                out[part] = self._block([words[i] for i in part.tolist()], n + 1)
        return out

    def _block(self, words: list[str], n: int) -> np.ndarray:
        m = len(words)
        points = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(U64)
        log = np.full((n + 1, m), -np.inf)
        log[0] = 0.0
        single = np.zeros((n, m))
        for i in range(n):
            kinds, which = np.unique(points[i], return_inverse=True)
            single[i] = np.array([-np.inf if chr(k) in self.score else self.fallback(chr(k)) for k in kinds.tolist()])[which]
        for i in range(n):
            # all pieces that start at i, pushed forward
            h = np.zeros(m, U64)
            for j in range(i, min(n, i + self.longest)):
                h = (h + points[j] + U64(1)) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(31)
                s = self._find(h)
                if j == i:
                    s = np.where(single[i] > -np.inf, single[i], s)
                hit = np.flatnonzero(s > -np.inf)
                if len(hit):
                    x, y = log[j + 1, hit], log[i, hit] + s[hit]
                    top = np.maximum(x, y)
                    gap = np.minimum(x, y) - top
                    log[j + 1, hit] = top + np.log10(1.0 + 10.0 ** np.where(np.isnan(gap), -np.inf, gap))
        return log[n]


def gather(table: pa.Table, pieces: Pieces) -> pa.Table:
    """One row for a group: its distinct words with training counts, where each bundle's words are, and piece counts."""
    asked = [x.as_py().split(b"\n") for x in table["words"]]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]).astype(np.int64)
    distinct = sorted(set().union(*asked))
    index = dict(zip(distinct, range(len(distinct)), strict=True))
    places = [np.fromiter(map(index.__getitem__, x), np.uint32, len(x)) for x in asked]
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, np.concatenate(places), counts)
    known = np.flatnonzero(total)
    found = pieces.count([distinct[i].decode() for i in known.tolist()], total[known])
    some = np.flatnonzero(found)
    row = [[table["g"][0].as_py()], [b"\n".join(distinct)], [total.tobytes()], [table["b"].to_pylist()], [[x.tobytes() for x in places]], [int(total.sum())], [len(known)], [some.tolist()], [found[some].tolist()]]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.table([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["g", "words", "counts", "bundles", "places", "total", "distinct", "pieces", "piece_counts"])


def piece_scores(size: int, counts: dict[int, int], ends: int) -> tuple[np.ndarray, float]:
    """log10 probabilities of the pieces and of the end."""
    number = np.zeros(size)
    for i, n in counts.items():
        number[i] = n
    whole = number.sum() + ends + SMOOTH * (size + 1)
    return np.log10((number + SMOOTH) / whole), float(np.log10((ends + SMOOTH) / whole))


def score(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", bundle_mb: float = 6.0) -> DataFrame:
    """Counts, base score (smoothed word unigrams) and lattice score of each row of `docs`."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    n = parts(text_bytes(docs), bundle_mb)
    docs = docs.withColumn("b", bundle_of(["doc_id", "text"], n))
    model = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a file of fixed size
    asked = docs.groupBy("b").applyInArrow(lambda key, table: asks(key, table, n), ASK)
    groups = stored(asked.groupBy("g").applyInArrow(lambda table: gather(table, Pieces(model.value)), GROUP))
    sums = groups.agg(F.sum("total"), F.sum("distinct")).first()
    ends = docs.filter(~F.col("held_out")).count()
    train, kinds = int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0)
    each = groups.select(F.explode(F.arrays_zip("pieces", "piece_counts")).alias("x")).groupBy("x.pieces").agg(F.sum("x.piece_counts").alias("n"))
    size = Pieces(model.value).size
    scores, end_score = piece_scores(size, {r[0]: r[1] for r in each.collect()}, ends)  # at most one row a piece
    shared = spark.sparkContext.broadcast(scores)
    whole = train + SMOOTH * (kinds + 1)

    def answers(batches):
        lattice = Lattice(Pieces(model.value), shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                words = row["words"].decode().split("\n")
                counts, logs = np.frombuffer(row["counts"], np.int64), lattice.many(words)
                at = [np.frombuffer(x, np.uint32) for x in row["places"]]
                yield pa.record_batch([pa.array(row["bundles"], pa.int32()), pa.array([row["g"]] * len(at), pa.int32()), pa.array([counts[x].tobytes() for x in at], pa.binary()), pa.array([logs[x].tobytes() for x in at], pa.binary())], names=["b", "g", "counts", "scores"])

    told = groups.select("g", "words", "counts", "bundles", "places").mapInArrow(answers, ANSWER)

    def final(table, answers):
        own = Bundle(table, n)
        rank = np.argsort(answers["g"].to_numpy(), kind="stable").tolist()
        counts = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(answers["counts"][i].as_py(), np.int64) for i in rank])
        logs = np.concatenate([np.zeros(0)] + [np.frombuffer(answers["scores"][i].as_py(), np.float64) for i in rank])
        base = np.log10((counts + SMOOTH) / whole)
        size = np.diff(own.first)
        some = np.flatnonzero(size)

        def summed(values, start, kind):
            out = np.full(len(size), start, kind)
            if len(some):
                out[some] += np.add.reduceat(values[own.place], own.first[some])
            return out

        known = summed((counts > 0).astype(np.int64), int(ends > 0), np.int64)
        base_score, text_score = summed(base, np.log10((ends + SMOOTH) / whole), np.float64), summed(logs, end_score, np.float64)
        return pa.table([table["doc_id"], table["held_out"], pa.array(size + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(size), train), pa.int64()), pa.array(base_score), pa.array(text_score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(final, SCHEMA)
