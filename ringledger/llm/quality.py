"""Operator 8, quality rules: line-first cleaning.

Every line with a word is judged by itself; lines that fail a rule are removed; a document goes if the words of the
removed lines are more than half of its words. Rules (fixed patterns below):
- punctuation: a line ends in a closing mark, and not more than three in ten of its words carry a run of marks
  (two or more of ! and ?, or three or more of # * $ % & and the like);
- navigation: a line of at least four words isn't a row of menu entries (three in ten words or more are bars or arrows);
- boilerplate: no licence, rights, cookie, login or script notices.
A closing mark is asked for only of lines of at least four words: headings stay.

Defined cases: a null or blank text has no words and fails the base rule; rows are judged one by one, so repeated rows
and ids don't matter; other columns are carried along by clean(); no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import raw_strings, slices

SYMBOLS = b"#*$%&|<>"
#: Fixed patterns, the same for Python and DuckDB.
CLOSED = r"[.!?:;…。！？][\"'”’»)\]]*[ \t\r]*$"
NOISY_WORD = r"[!?]{2}|[#*$%&|<>=_~^+]{3}"
MENU_WORD = r"^(?:[|»›>•·]+|->|=>)$"
NOTICE = r"all rights reserved|licensed under|released under the|creative commons|cookie|privacy policy|terms of (?:use|service)|enable javascript|click here|sign (?:in|up)|log ?in to|subscribe"
FEW_WORDS = 4

_CLOSED, _NOISY, _MENU, _NOTICE = (re.compile(x) for x in (CLOSED, NOISY_WORD, MENU_WORD, NOTICE))
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")

OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines_removed", pa.int64()), ("n_words_removed", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_removed long, n_words_removed long, base_failed boolean, kept boolean, cleaned string"


def line_fails(line: str, words: list[str]) -> bool:
    """Judges one line; `words` are its words, at least one."""
    n = len(words)
    if _NOTICE.search(line.lower()):
        return True
    if n < FEW_WORDS:
        return False
    if not _CLOSED.search(line):
        return True
    if ("|" in line or ">" in line or "»" in line or "›" in line or "•" in line or "·" in line) and 10 * sum(1 for w in words if _MENU.search(w)) >= 3 * n:
        return True
    return bool(_NOISY.search(line)) and 10 * sum(1 for w in words if _NOISY.search(w)) > 3 * n


def repeated_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text has more than once."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total, until = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + width - max(until, i)
            until = i + width
    return total


def judge(table: pa.Table) -> pa.Table:
    flat, at = raw_strings(table["text"])
    symbol, blank = np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    blank[[0x20, *range(0x09, 0x0E)]] = True
    counts, held = [], np.flatnonzero(np.diff(at))
    for marks in (symbol[flat], ~blank[flat] & ((flat & 0xC0) != 0x80)):
        count = np.zeros(len(at) - 1, np.int64)
        if len(held):
            count[held] = np.add.reduceat(marks.view(np.uint8), at[held], dtype=np.int64)
        counts.append(count)
    data, rows = flat.tobytes(), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        raw = data[a:b]
        seen: set[bytes] = set()
        lines, all_words, n_dup, lost, gone = [], [], 0, 0, 0
        for line in raw.split(b"\n"):
            words = line.split()
            if words:
                all_words += words
                if line in seen:
                    n_dup += 1
                seen.add(line)
                if line_fails(line.decode(), [w.decode() for w in words]):
                    gone += 1
                    lost += len(words)
                    continue
            lines.append(line)
        n, rep = len(all_words), repeated_words(all_words)
        failed = n < 50 or 100 * rep > 50 * n
        rows.append((n, n_dup, rep, gone, lost, failed, not failed and 2 * lost <= n, b"\n".join(lines).decode()))
    n, n_dup, rep, gone, lost, failed, kept, text = zip(*rows, strict=True) if rows else ([],) * 8
    long = lambda x: pa.array(x, pa.int64())
    return pa.table([table["doc_id"].cast(pa.int64()), long(n), long(counts[1]), long(counts[0]), long(n_dup), long(rep), long(gone), long(lost), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(text, pa.string())], schema=OUT)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The counts, verdict and cleaned text of each row; no shuffle."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keep = len(OUT) if with_text else len(OUT) - 1

    def run(batches):
        for batch in slices(batches):
            yield from judge(pa.Table.from_batches([batch])).select(range(keep)).to_batches()

    return slim.mapInArrow(run, ", ".join(DDL.split(", ")[:keep]))


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents, without the lines that failed; columns as in `docs` (chars_col, if there, counts anew)."""
    schema = docs.schema
    at = docs.columns.index(text_col)
    other = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        for batch in slices(batches):
            table = pa.Table.from_batches([batch])
            found = judge(pa.table({"doc_id": pa.nulls(len(table), pa.int64()), "text": table.column(at)}))
            changed = pa.compute.greater(found["n_lines_removed"], 0)
            text = pa.compute.if_else(changed, found["cleaned"], table.column(at).cast(pa.string()))
            out = table.set_column(at, table.schema.field(at), text.cast(table.schema.field(at).type))
            if other is not None:
                field = table.schema.field(other)
                n = pa.compute.if_else(changed, pa.compute.utf8_length(text).cast(field.type), table.column(other))
                out = out.set_column(other, field, n)
            yield from out.filter(found["kept"]).to_batches()

    import pyarrow.compute  # noqa: F401

    return docs.mapInArrow(run, schema)
