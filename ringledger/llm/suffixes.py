"""Operator 5, suffix-array deduplication over bytes: deep-shallow sorting of the suffixes that can match.

A byte goes if a 50-byte string over it also starts in a text with a smaller id. Suffixes reach their bucket as
super-k-mers (superkmers.py), which leaves out the suffixes that no other one can match. In a bucket, multikey
quicksort orders suffixes to a shallow depth, eight bytes a digit; groups that still agree there are told apart by
blind tries. Neighbours in that order that agree on 50 bytes form a class, which belongs to its smallest id.

Defined cases: a null or empty text has no bytes; a shorter text than 50 bytes keeps all; rows with one id don't
remove each other's bytes; a row without an id counts as later than all others; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ringledger.llm import superkmers as S
from ringledger.llm.common import U64, mix, raw_strings, runs
from ringledger.llm.substrings import ids_of

SCHEMA = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
DIGIT = 8


def digits(data: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """Eight bytes at every position as one integer (not aligned, no copy)."""
    return np.ndarray((max(0, len(data) - DIGIT + 1),), dtype, np.ascontiguousarray(data), strides=(1,))


def read_bytes(table: pa.Table, k: int) -> S.Texts:
    flat, at = raw_strings(table["text"])
    words = digits(flat)
    n = max(0, len(flat) - k + 1)
    kgrams = np.zeros(n, U64)
    for j in range(0, k, DIGIT):
        j = min(j, k - DIGIT)
        kgrams *= U64(0x9E3779B97F4A7C15)
        kgrams ^= words[j : j + n]
        kgrams ^= kgrams >> U64(29)
    kgrams *= U64(0xBF58476D1CE4E5B9)
    kgrams ^= kgrams >> U64(32)
    kgrams *= U64(0x94D049BB133111EB)
    return S.Texts(kgrams, at, ids_of(table), None, flat)


class BlindTrie:
    """A trie whose nodes keep the place where strings part and only the bytes they part on (a Patricia trie).

    To insert a string, go down without looking at what lies between branchings, compare once with any string of the
    leaf that is reached, and branch where the two differ first.
    """

    __slots__ = ("root", "same")

    def __init__(self) -> None:
        self.root: list | bytes | None = None
        self.same: dict[bytes, list[int]] = {}

    def insert(self, text: bytes, item: int) -> None:
        if text in self.same:
            self.same[text].append(item)
            return
        self.same[text] = [item]
        if self.root is None:
            self.root = text
            return
        node = self.root
        while not isinstance(node, bytes):  # blind: only the branching bytes are looked at
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        depth = next(i for i, (x, y) in enumerate(zip(text, node, strict=True)) if x != y)
        old, parent, node = node, None, self.root
        while not isinstance(node, bytes) and node[0] < depth:
            parent, node = (node, text[node[0]]), node[1][text[node[0]]]
        if not isinstance(node, bytes) and node[0] == depth:
            node[1][text[depth]] = text
            return
        fork = [depth, {old[depth]: node, text[depth]: text}]
        if parent is None:
            self.root = fork
        else:
            parent[0][1][parent[1]] = fork

    def ordered(self) -> list[list[int]]:
        """The items of equal strings, strings in order."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, bytes):
                out.append(self.same[node])
            elif node is not None:
                stack += [node[1][x] for x in sorted(node[1], reverse=True)]
        return out


def deep_shallow(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int, shallow: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Orders the strings data[start : start + length] in each group (groups ascending).

    Gives the order and, for each place in it, the number of its class of equal strings.
    """
    padded = np.concatenate((data, np.zeros(DIGIT, np.uint8)))
    word = digits(padded, ">u8")
    order = np.argsort(group, kind="stable")
    label = np.zeros(len(start), np.int64)
    cuts = runs(group[order])
    label[:] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for depth in range(0, min(shallow, length - DIGIT + 1), DIGIT):
        # multikey quicksort, all open groups at once: suffixes of a group are parted by their next digit
        size = np.bincount(label)
        open_ = np.flatnonzero(size[label] > 1)
        if not len(open_):
            break
        items = order[open_]
        digit = word[start[items] + depth].astype(U64)
        by = np.lexsort((digit, label[open_]))
        order[open_] = items[by]
        step = np.zeros(len(label), np.int64)
        d, g = digit[by], label[open_]
        step[open_[1:]] = (d[1:] != d[:-1]) & (g[1:] == g[:-1])
        label = np.cumsum(np.concatenate(([0], label[1:] != label[:-1])) + step)
    depth = min(shallow, (length // DIGIT) * DIGIT)
    # what agrees on all of the rest needs no trie
    size = np.bincount(label)
    open_ = np.flatnonzero(size[label] > 1)
    fork = np.zeros(len(label), np.int64)
    if len(open_) and depth < length:
        cuts = runs(label)
        head = np.repeat(cuts[:-1], np.diff(cuts))
        differs = np.zeros(len(label), bool)
        for at in (*range(depth, length - DIGIT + 1, DIGIT), length - DIGIT):
            differs[open_] |= word[start[order[open_]] + at] != word[start[order[head[open_]]] + at]
        deep = np.unique(label[differs])
        blob = data.tobytes()
        for g in deep.tolist():
            a, b = int(cuts[g]), int(cuts[g + 1])
            trie = BlindTrie()
            for i in order[a:b].tolist():
                s = int(start[i])
                trie.insert(blob[s : s + length], i)
            at = a
            for same in trie.ordered():
                order[at : at + len(same)] = same
                if at > a:
                    fork[at] = 1
                at += len(same)
    label = np.cumsum(np.concatenate(([0], label[1:] != label[:-1])) + fork) if len(label) else label
    return order, label


def judge_owners(bucket: S.Bucket, length: int) -> tuple[np.ndarray, list[int]]:
    """Every super-k-mer is an exception for its smallest owner: there, only windows that a smaller id has too are removed."""
    every = np.arange(len(bucket.text))
    masks = np.zeros(len(every), U64)
    cuts = runs(bucket.name)
    mixed = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    pick = np.flatnonzero(mixed)
    if len(pick):
        data = np.frombuffer(b"".join(bucket.text[i] for i in pick.tolist()), np.uint8)
        size = bucket.count[pick] + length - 1
        begin = np.cumsum(size) - size
        count = bucket.count[pick]
        which = np.repeat(np.arange(len(pick)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        kinds = np.cumsum(np.concatenate(([0], bucket.name[pick][1:] != bucket.name[pick][:-1])))
        order, label = deep_shallow(data, begin[which] + offset, kinds[which], length)
        owner = bucket.owner[pick][which[order]]
        least = np.minimum.reduceat(owner, runs(label)[:-1])
        gone = order[least[label] < owner]
        np.bitwise_or.at(masks, pick[which[gone]], U64(1) << offset[gone].astype(U64))
    return every, masks.tolist()


def remove_seen(docs: DataFrame, length: int = 50, k: int = 24, id_col: str = "doc_id", text_col: str = "text", bundle_mb: float = 6.0, hot: int | None = None) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans for each row of `docs`.

    hot = superkmers.HOT deals windows of hot minimisers one by one: smaller groups, at up to 50 bytes for each byte there.
    """

    def read(table):
        texts = read_bytes(table, k)
        data = texts.own.tobytes()
        texts.piece = lambda a, b: data[a : b + length - 1]
        return texts

    def finish(table, texts, gone):
        flat, at = texts.own, texts.first
        total = np.concatenate(([0], np.cumsum(gone)))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = at[:-1][(at[:-1] > 0) & (at[:-1] < len(gone))]
        begins[inner] = gone[inner]
        spans = np.concatenate(([0], np.cumsum(begins)))
        removed, n_spans = total[at[1:]] - total[at[:-1]], spans[at[1:]] - spans[at[:-1]]
        kept = flat[~gone].tobytes()
        ends = np.concatenate(([0], np.cumsum(np.diff(at) - removed))).tolist()
        rest = [kept[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([table["doc_id"], pa.array(rest, pa.binary()), *(pa.array(x, pa.int64()) for x in (np.diff(at), removed, n_spans))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return S.mark(docs, id_col, text_col, length=length, k=k, read=read, judge=lambda x: judge_owners(x, length), finish=finish, schema=SCHEMA, bundle_mb=bundle_mb, hot=hot)
