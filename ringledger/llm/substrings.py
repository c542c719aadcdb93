"""Operator 3, substring deduplication: words covered by a window that occurs more than once go.

Super-k-mer partitioning: see superkmers.py. Windows are judged on the input, so all occurrences go.
Defined cases: a null or blank text has no words; a text shorter than a window keeps all its words; repeated rows
repeat each other's windows; rows without an id count like others; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ringledger.llm import superkmers as S
from ringledger.llm.common import U64, mix, raw_strings

SCHEMA = "doc_id long, text string, n_words long, n_removed long"


def read_words(table: pa.Table, k: int) -> S.Texts:
    """A bundle as words; `own` is the flat list of words."""
    flat, at = raw_strings(table["text"])
    data = flat.tobytes()
    words: list[bytes] = []
    first = [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        words += data[a:b].split()
        first.append(len(words))
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    kgrams = np.zeros(max(0, len(each) - k + 1), U64)
    for j in range(k):
        kgrams = kgrams * U64(0x9E3779B97F4A7C15) + each[j : j + len(kgrams)]
    return S.Texts(mix(kgrams), np.array(first, np.int64), ids_of(table), None, words)


def ids_of(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(S.NO_ID).to_numpy().astype(np.int64)


def judge_counts(bucket: S.Bucket, length: int) -> tuple[np.ndarray, list[int]]:
    """Sorts the windows of each minimiser. A super-k-mer that occurs twice is removed everywhere; one that occurs once, by window."""
    chosen, masks = [], []
    cuts = S.runs(bucket.name)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        single = [i for i in range(a, b) if bucket.times[i] == 1]
        if not single:
            continue
        windows = []
        for i in range(a, b):
            words = bucket.text[i].split()
            windows += [(b" ".join(words[j : j + length]), i, j) for j in range(bucket.count[i])]
        windows.sort()
        found = dict.fromkeys(single, 0)
        at = 0
        while at < len(windows):
            end = at + 1
            while end < len(windows) and windows[end][0] == windows[at][0]:
                end += 1
            if end - at > 1:
                for _, i, j in windows[at:end]:
                    if i in found:
                        found[i] |= 1 << j
            at = end
        chosen += found.keys()
        masks += found.values()
    return np.array(chosen, np.int64), masks


def remove_repeated(docs: DataFrame, window: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text", bundle_mb: float = 6.0, hot: int = S.HOT) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed for each row of `docs`."""

    def read(table):
        texts = read_words(table, k)
        texts.piece = lambda a, b: b" ".join(texts.own[a : b + window - 1])
        return texts

    def finish(table, texts, gone):
        first, words = texts.first.tolist(), texts.own
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[texts.first[1:]] - total[texts.first[:-1]]
        kept = []
        for a, b, r in zip(first[:-1], first[1:], removed.tolist(), strict=True):
            kept.append(b" ".join(words[a:b] if not r else [w for w, g in zip(words[a:b], gone[a:b].tolist(), strict=True) if not g]))
        text = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table([table["doc_id"], text, pa.array(np.diff(texts.first), pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return S.mark(docs, id_col, text_col, length=window, k=k, read=read, judge=lambda x: judge_counts(x, window), finish=finish, schema=SCHEMA, bundle_mb=bundle_mb, hot=hot)
