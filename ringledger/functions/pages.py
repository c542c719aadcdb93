"""Fields and nested tables of HTML pages: a tokenizer of tags with a stack, row by row in Arrow batches.

Malformed pages don't raise: an element that is never closed ends with the page, a stray end tag is skipped, what is
missing is null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, which never open a level.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
NONE: frozenset = frozenset()
#: Text of these is no content.
SILENT = frozenset(("script", "style"))
#: Plain markup: text without references, tags without odd quotes, nothing whose content is raw. Other pages go through HTMLParser whole.
_TAG = r"""(?!</?(?:script|style|title|textarea|xmp|plaintext|iframe|noembed|noframes|noscript|svg|math)\b)<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z-]*=(?:"[^"'<>&]*"|[a-zA-Z0-9_-]+))*)[ \t\n\r\f]*>"""
TOKEN = re.compile(f"([^<&]+)|{_TAG}", re.IGNORECASE)
PLAIN = re.compile(f"(?:[^<&]+|{_TAG})*+", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z-]*)=(?:"([^"]*)"|([a-zA-Z0-9_-]+))""")
ROWS = "table int, parent int, parent_row int, row int, cells array<string>"


class Page(HTMLParser):
    """What a page says: own texts of elements by (tag, classes) in order, and the rows of its tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset, list[str]]] = []  # tag, classes, own text
        self.closed: list[tuple[int, str, frozenset, str]] = []  # place of the start tag, ...
        self.at: list[int] = []
        self.starts = 0
        self.tables: list[dict] = []  # open tables, the innermost last
        self.rows: list[tuple[int, int | None, int | None, int, list[str]]] = []
        self.n_tables = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            above = self.tables[-1] if self.tables else None
            self.tables.append({"number": self.n_tables, "parent": above and above["number"], "parent_row": above and max(0, above["row"] - 1), "row": 0, "cells": None, "cell": None})
            self.n_tables += 1
        elif self.tables:
            here = self.tables[-1]
            if tag == "tr":
                self._end_row(here)
                here["cells"], here["row"] = [], here["row"] + 1
            elif tag in ("td", "th"):
                self._end_cell(here)
                if here["cells"] is None:
                    here["cells"], here["row"] = [], here["row"] + 1
                here["cell"] = []
        if tag not in VOID:
            classes = frozenset((dict(attrs).get("class") or "").split()) if attrs else NONE
            self.open.append((tag, classes, []))
            self.at.append(self.starts)
        self.starts += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.tables:
            self._end_row(self.tables.pop())
        elif self.tables and tag == "tr":
            self._end_row(self.tables[-1])
        elif self.tables and tag in ("td", "th"):
            self._end_cell(self.tables[-1])
        if any(t == tag for t, _, _ in self.open):
            while True:
                t, classes, text = self.open.pop()
                self.closed.append((self.at.pop(), t, classes, " ".join("".join(text).split())))
                if t == tag:
                    return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] not in SILENT:
            self.open[-1][2].append(data)
            if self.tables and self.tables[-1]["cell"] is not None:
                self.tables[-1]["cell"].append(data)

    def _end_cell(self, table: dict) -> None:
        if table["cell"] is not None:
            table["cells"].append(" ".join("".join(table["cell"]).split()))
            table["cell"] = None

    def _end_row(self, table: dict) -> None:
        self._end_cell(table)
        if table["cells"]:
            self.rows.append((table["number"], table["parent"], table["parent_row"], table["row"] - 1, table["cells"]))
        table["cells"] = None

    def _plain(self, html: str) -> None:
        """What feed() does with plain markup, several times as fast."""
        for text, end, tag, attributes in TOKEN.findall(html):
            if text:
                self.handle_data(text)
            elif end:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), [(n.lower(), x or y) for n, x, y in ATTRIBUTE.findall(attributes)] if attributes else [])

    def finish(self, html: str) -> Page:
        if PLAIN.fullmatch(html):
            self._plain(html)
        else:
            self.feed(html)
            self.close()
        while self.tables:
            self._end_row(self.tables.pop())
        while self.open:
            t, classes, text = self.open.pop()
            self.closed.append((self.at.pop(), t, classes, " ".join("".join(text).split())))
        self.closed.sort(key=lambda x: x[0])
        self.rows.sort(key=lambda x: (x[0], x[3]))
        return self

    def first(self, tag: str | None, name: str | None) -> str | None:
        """Own text of the first element of that tag and class (either may be None) that has any."""
        return next((x for _, t, c, x in self.closed if (tag is None or t == tag) and (name is None or name in c) and x), None)

    def labelled(self, label: str, value: str) -> dict[str, str]:
        """Texts of the class `value`, each under the text of the class `label` before it; the first of a label counts."""
        out: dict[str, str] = {}
        last = None
        for _, _, classes, text in self.closed:
            if label in classes:
                last = text.lower()
            elif value in classes and last:
                out.setdefault(last, text)
                last = None
        return out


def fields(pages: DataFrame, key: str, html: str, wanted: Mapping[str, tuple], label: str | None = None, value: str | None = None, labels: Mapping[str, str] | None = None) -> DataFrame:
    """key and a string column for each wanted (tag, class), tried in order if several, and for each label of a label-value list."""
    kind = dict(pages.dtypes)[key]
    names = [*wanted, *(labels or {})]

    def run(batches):
        for batch in batches:
            columns = {n: [] for n in names}
            for text in batch.column(1).to_pylist():
                page = Page().finish(text or "")
                told = page.labelled(label, value) if label else {}
                for n, ways in wanted.items():
                    ways = ways if isinstance(ways[0], tuple) else (ways,)
                    columns[n].append(next((x for w in ways if (x := page.first(*w))), None))
                for n, word in (labels or {}).items():
                    columns[n].append(told.get(word.lower()))
            yield pa.record_batch([batch.column(0), *(pa.array(columns[n], pa.string()) for n in names)], names=["key", *names])

    return pages.select(F.col(key).alias("key"), html).mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} string" for n in names)).withColumnRenamed("key", key)


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and a row for each row of each table: number of the table, the table and row that it is nested in, its place, its cells."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in Page().finish(text or "").rows:
                    for column, x in zip(out, (k, *row), strict=True):
                        column.append(x)
            types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["key", "table", "parent", "parent_row", "row", "cells"])

    return pages.select(F.col(key).alias("key"), html).mapInArrow(run, f"key {kind}, {ROWS}").withColumnRenamed("key", key)
