"""Windows that occur more than once, found exactly without sending every window.

A text is a sequence of symbols (words or bytes); a window is `length` consecutive symbols of one text. The leftmost
k-gram with the smallest hash is its minimiser. Equal windows have equal minimisers at the same offset, and neighbouring
windows mostly share one, so a run of windows with their minimiser at one place travels to the minimiser's bucket as
one packed string, its super-k-mer. There, sorting tells which windows are the same. Equal windows of one text never
lie in one run, as their minimisers are at different places.

1. Each bundle of texts sends the 32-bit names of its distinct minimisers; a bucket group tells it which of them occur
   elsewhere too. A minimiser that occurs once can't belong to a repeated window.
2. For the rest, the bundle sends each distinct super-k-mer once, with its smallest owner and its count.
3. The bucket compares windows exactly and answers only for the super-k-mers whose windows aren't all repeated.
4. The bundle marks what the windows cover.

Group sizes follow the input: a bucket group gets what a few megabytes of text gave, and each bundle at most one row
for each group. Inside a passage that a third of all texts hold, super-k-mers are the same in all of them: one a bundle.
Across its border they differ from text to text while the minimiser stays the same. Step 1 sees that by a sketch of how
many different super-k-mers a minimiser has; above a limit its windows travel one by one, dealt by a hash of the whole
window. Equal windows have one minimiser, so that they are either all cut or all not, and meet in both cases.
Without a limit (hot = None) nothing is asked or cut, and a minimiser's super-k-mers stay in one group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import U64, bundle_of, mix, parts, runs, split_blobs, text_bytes

#: Windows in one super-k-mer at most: the bits of a mask.
LONGEST_RUN = 64
#: Marks that a sketch tells apart, and how many of them make a minimiser hot: 48 of 64 are met by about 90 bundles with
#: different super-k-mers. The limit says how windows travel, not which.
MARKS, HOT = 64, 48
NO_ID = np.iinfo(np.int64).max


@dataclass
class Texts:
    """A bundle as symbols: `kgrams` has a hash for each k-gram start of the concatenated texts, `first` the n + 1 symbol offsets of the texts."""

    kgrams: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    piece: Callable[[int, int], bytes]
    own: object = None


@dataclass
class Runs:
    start: np.ndarray
    count: np.ndarray
    name: np.ndarray
    group: np.ndarray
    owner: np.ndarray


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def find_runs(texts: Texts, length: int, k: int, groups: int) -> Runs:
    """The runs of windows with one minimiser; none crosses the end of a text."""
    none = np.zeros(0, np.int64)
    n = int(texts.first[-1])
    if n < length:
        return Runs(none, none, none.astype(U64), none, none)
    width = length - k + 1
    assert width <= LONGEST_RUN, "more windows than a mask has bits"
    mask = U64((1 << n.bit_length()) - 1)
    place = sliding_min((texts.kgrams & ~mask) | np.arange(len(texts.kgrams), dtype=U64), width) & mask
    sizes = np.diff(texts.first)
    fits = np.maximum(sizes - length + 1, 0)
    held = np.flatnonzero(fits)
    if not len(held):
        return Runs(none, none, none.astype(U64), none, none)
    change = np.empty(len(place), bool)
    change[0] = True
    np.not_equal(place[1:], place[:-1], out=change[1:])
    begin, end = texts.first[held], texts.first[held] + fits[held]
    change[begin] = True
    inside = np.zeros(len(place) + 1, np.int8)
    inside[begin] += 1
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    stop = np.zeros(len(place) + 1, bool)
    stop[end] = True
    start = np.flatnonzero(change & inside)
    ends = np.flatnonzero((change & inside) | stop[:-1])
    ends = np.append(ends, len(place)) if stop[-1] else ends
    count = ends[np.searchsorted(ends, start, side="right")] - start
    name = mix(texts.kgrams[place[start].astype(np.int64)])
    return Runs(start, count, name, ((name >> U64(32)) % U64(groups)).astype(np.int64), np.searchsorted(texts.first, start, side="right") - 1)


def sketch(texts: Texts, found: Runs, length: int, k: int) -> np.ndarray:
    """A hash of each super-k-mer by its two ends and its size."""
    last = found.start + found.count + length - 1 - k
    return mix(texts.kgrams[found.start] * U64(0x9E3779B97F4A7C15) + texts.kgrams[last] + found.count.astype(U64))


def single_windows(texts: Texts, found: Runs, hot: np.ndarray, length: int, k: int, groups: int) -> Runs:
    """Hot runs as runs of one window, named by the whole window."""
    if not hot.any():
        return found
    rest, count = ~hot, found.count[hot]
    which = np.repeat(np.flatnonzero(hot), count)
    start = found.start[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    name = np.zeros(len(which), U64)
    for at in (*range(0, length - k, k), length - k):
        name = name * U64(0x9E3779B97F4A7C15) + texts.kgrams[start + at]
    name = np.concatenate((found.name[rest], mix(name)))
    start, count = np.concatenate((found.start[rest], start)), np.concatenate((found.count[rest], np.ones(len(which), np.int64)))
    return Runs(start, count, name, ((name >> U64(32)) % U64(groups)).astype(np.int64), np.concatenate((found.owner[rest], found.owner[which])))


ASK = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("names", pa.binary()), ("more", pa.binary())])
ANSWER = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("bits", pa.binary())])
MARKED_ASK = ASK.append(pa.field("marks", pa.binary()))
MARKED_ANSWER = ANSWER.append(pa.field("hot", pa.binary()))
SEND = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("names", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("owners", pa.binary()), ("times", pa.binary()), ("data", pa.binary())])
EXCEPT = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("which", pa.binary()), ("masks", pa.binary())])
SQL_OF = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_OF[f.type]}" for f in schema)


def names_by_group(found: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, 32-bit name) in order, each run's place among them, and each one's number of runs."""
    key = (found.group.astype(U64) << U64(32)) | (found.name & U64(0xFFFFFFFF))
    distinct, place, times = np.unique(key, return_inverse=True, return_counts=True)
    return (distinct >> U64(32)).astype(np.int64), (distinct & U64(0xFFFFFFFF)).astype(np.uint32), place, times


def sorted_names(found: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """names_by_group without the places, which takes a plain sort."""
    key = np.sort((found.group.astype(U64) << U64(32)) | (found.name & U64(0xFFFFFFFF)))
    cuts = runs(key)
    distinct = key[cuts[:-1]]
    return (distinct >> U64(32)).astype(np.int64), (distinct & U64(0xFFFFFFFF)).astype(np.uint32), np.diff(cuts)


def told_names(found: Runs, answers: pa.Table) -> np.ndarray:
    """The answer to the name of each run; told_bits has one for each distinct name."""
    group, name, _ = sorted_names(found)
    told = told_bits(group, answers)
    wanted = (group[told].astype(U64) << U64(32)) | name[told]
    out = np.zeros(len(found.name), bool)
    if len(wanted):
        sieve = np.zeros(1 << 20, bool)  # most names are not among them
        sieve[wanted & U64(0xFFFFF)] = True
        maybe = np.flatnonzero(sieve[found.name & U64(0xFFFFF)])
        key = (found.group[maybe].astype(U64) << U64(32)) | (found.name[maybe] & U64(0xFFFFFFFF))
        out[maybe] = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
    return out


def ask(bundle: int, found: Runs, sketches: np.ndarray | None = None) -> pa.Table:
    """With sketches, a name also carries a mark: that of its smallest sketch here."""
    if sketches is None:
        group, name, times = sorted_names(found)
    else:
        group, name, place, times = names_by_group(found)
    cuts = runs(group)
    heads = group[cuts[:-1]]
    more = [np.packbits(times[a:b] > 1).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    table = pa.table([pa.array(heads, pa.int32()), pa.array(np.full(len(heads), bundle), pa.int32()), pa.array(split_blobs(name, cuts), pa.binary()), pa.array(more, pa.binary())], schema=ASK)
    if sketches is None:
        return table
    least = np.full(len(name), np.iinfo(U64).max, U64)
    np.minimum.at(least, place, sketches)
    return table.append_column(MARKED_ASK.field("marks"), pa.array(split_blobs((least % U64(MARKS)).astype(np.uint8), cuts), pa.binary()))


def answer(table: pa.Table) -> pa.Table:
    """answer_within for asks without marks; one argument, as applyInArrow takes a second one for the key."""
    return answer_within(table, HOT)


def answer_within(table: pa.Table, limit: int | None) -> pa.Table:
    """Which names of each bundle occur in another one, or twice in its own; if asked with marks, also which have `limit` marks or more."""
    each = [np.frombuffer(x.as_py(), np.uint32) for x in table["names"]]
    more = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(n)).astype(bool) for x, n in zip(table["more"], each, strict=True)]
    whole = np.concatenate(each)
    order = np.argsort(whole, kind="stable")
    cuts = runs(whole[order])
    size = np.diff(cuts)
    shared = np.empty(len(whole), bool)
    shared[order] = np.repeat(size > 1, size)
    shared |= np.concatenate(more)
    ends = np.cumsum([len(x) for x in each])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(shared, ends)]
    out = pa.table([table["b"], table["g"], pa.chunked_array([pa.array(bits, pa.binary())])], schema=ANSWER)
    if "marks" not in table.column_names:
        return out
    hot = np.zeros(len(whole), bool)
    often = np.flatnonzero(size >= limit)
    if len(often):
        marks = np.frombuffer(b"".join(x.as_py() for x in table["marks"]), np.uint8)[order]
        for i in often.tolist():
            a, b = int(cuts[i]), int(cuts[i + 1])
            hot[order[a:b]] = np.count_nonzero(np.bincount(marks[a:b])) >= limit
    told = [np.packbits(x).tobytes() if x.any() else None for x in np.split(hot, ends)]
    return out.append_column(MARKED_ANSWER.field("hot"), pa.array(told, pa.binary()))


def told_bits(group: np.ndarray, answers: pa.Table, column: str = "bits") -> np.ndarray:
    """The answers to the names of a bundle; `group` has the group of each name, in order."""
    shared = np.zeros(len(group), bool)
    for g, bits in zip(answers["g"].to_pylist(), answers[column].to_pylist(), strict=True):
        if bits is None:
            continue
        a, b = np.searchsorted(group, [g, g + 1])
        shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return shared


def shared_runs(found: Runs, answers: pa.Table) -> tuple[Runs, np.ndarray]:
    """The runs whose minimiser occurs more than once, and which of them are hot."""
    group, _, place, _ = names_by_group(found)
    keep = told_bits(group, answers)[place]
    hot = told_bits(group, answers, "hot") if "hot" in answers.column_names else np.zeros(len(group), bool)
    return Runs(*(getattr(found, x)[keep] for x in ("start", "count", "name", "group", "owner"))), hot[place[keep]]


@dataclass
class Distinct:
    """Distinct super-k-mers of a bundle in order of (group, minimiser, string), and each run's place among them."""

    place: np.ndarray
    group: np.ndarray
    name: np.ndarray
    count: np.ndarray
    text: list[bytes]
    owner: np.ndarray
    times: np.ndarray


def distinct(texts: Texts, found: Runs) -> Distinct:
    first, last = found.start.tolist(), (found.start + found.count).tolist()
    pieces = [texts.piece(a, b) for a, b in zip(first, last, strict=True)]
    keys = list(zip(found.group.tolist(), found.name.tolist(), pieces, found.count.tolist(), strict=True))
    ordered = sorted(set(keys))
    at = dict(zip(ordered, range(len(ordered)), strict=True))
    place = np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))
    owner = np.full(len(ordered), NO_ID)
    np.minimum.at(owner, place, texts.ids[found.owner] if len(found.owner) else np.zeros(0, np.int64))
    group, name, text, count = zip(*ordered, strict=True) if ordered else ((), (), (), ())
    return Distinct(place, np.array(group, np.int64), np.array(name, U64), np.array(count, np.int64), list(text), owner, np.bincount(place, minlength=len(ordered)))


def send(bundle: int, own: Distinct) -> pa.Table:
    cuts = runs(own.group)
    sizes = np.fromiter(map(len, own.text), np.int64, len(own.text))
    blobs = [split_blobs(x, cuts) for x in (own.name, own.count.astype(np.uint8), sizes.astype(np.uint32), own.owner, own.times.astype(np.uint32))]
    data = [b"".join(own.text[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    heads = own.group[cuts[:-1]]
    return pa.table([pa.array(heads, pa.int32()), pa.array(np.full(len(heads), bundle), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs), pa.array(data, pa.binary())], schema=SEND)


@dataclass
class Bucket:
    """All super-k-mers of a bucket group, those of one minimiser together, equal ones merged: smallest owner, total count."""

    name: np.ndarray
    count: np.ndarray
    text: list[bytes]
    owner: np.ndarray
    times: np.ndarray


def exceptions(table: pa.Table, judge: Callable[[Bucket], tuple[np.ndarray, list[int]]]) -> pa.Table:
    """judge(bucket) gives the merged super-k-mers that are exceptions and, as a bit mask for each, its windows to remove.

    The exception goes to the bundle that holds the smallest owner; any other occurrence is removed as a whole.
    """
    bundle, group = table["b"].to_pylist(), table["g"][0].as_py()
    col = {x: [np.frombuffer(v.as_py(), kind) for v in table[x]] for x, kind in (("names", np.uint64), ("counts", np.uint8), ("sizes", np.uint32), ("owners", np.int64), ("times", np.uint32))}
    data = [x.as_py() for x in table["data"]]
    merged: dict = {}
    for row, b in enumerate(bundle):
        blob, at = data[row], 0
        for i, (name, count, size, owner, times) in enumerate(zip(*(col[x][row].tolist() for x in ("names", "counts", "sizes", "owners", "times")), strict=True)):
            key = (name, blob[at : at + size], count)
            at += size
            old = merged.get(key)
            if old is None:
                merged[key] = [owner, b, i, times]
            else:
                old[3] += times
                if owner < old[0]:
                    old[:3] = [owner, b, i]
    ordered = sorted(merged)
    values = [merged[x] for x in ordered]
    bucket = Bucket(np.array([x[0] for x in ordered], U64), np.array([x[2] for x in ordered], np.int64), [x[1] for x in ordered], np.array([x[0] for x in values], np.int64), np.array([x[3] for x in values], np.int64))
    chosen, masks = judge(bucket)
    back: dict[int, list] = {}
    for i, mask in zip(chosen.tolist(), masks, strict=True):
        back.setdefault(values[i][1], []).append((values[i][2], mask))
    out = [(b, group, np.array([x[0] for x in v], np.uint32).tobytes(), np.array([x[1] for x in v], np.uint64).tobytes()) for b, v in back.items()]
    return pa.table([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), EXCEPT.types, strict=True)], schema=EXCEPT) if out else EXCEPT.empty_table()


def covered(texts: Texts, found: Runs, own: Distinct, answers: pa.Table, length: int) -> np.ndarray:
    """Which symbols a removed window covers."""
    n = int(texts.first[-1])
    cover = np.zeros(n + 1, np.int32)
    mask, special = np.zeros(len(own.text), U64), np.zeros(len(own.text), bool)
    cuts = {int(own.group[a]): int(a) for a in runs(own.group)[:-1]} if len(own.group) else {}
    for g, which, masks in zip(*(answers[x].to_pylist() for x in ("g", "which", "masks")), strict=True):
        at = cuts[g] + np.frombuffer(which, np.uint32).astype(np.int64)
        special[at], mask[at] = True, np.frombuffer(masks, np.uint64)
    part = special[own.place] & (texts.ids[found.owner] == own.owner[own.place])
    whole = ~part
    np.add.at(cover, found.start[whole], 1)
    np.add.at(cover, found.start[whole] + found.count[whole] + length - 1, -1)
    some = np.flatnonzero(part & (mask[own.place] != 0))
    if len(some):
        bits = (mask[own.place[some]][:, None] >> np.arange(LONGEST_RUN, dtype=U64)) & U64(1)
        row, at = np.nonzero(bits)
        first = found.start[some][row] + at
        np.add.at(cover, first, 1)
        np.add.at(cover, first + length, -1)
    return np.cumsum(cover[:-1]) > 0


def mark(docs: DataFrame, id_col: str, text_col: str, *, length: int, k: int, read: Callable, judge: Callable, finish: Callable, schema: str, bundle_mb: float, hot: int | None = HOT) -> DataFrame:
    """Runs the four steps. read(table) makes Texts of a bundle; finish(table, texts, covered) makes its rows of the result."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = parts(text_bytes(docs), bundle_mb)
    docs = docs.withColumn("b", bundle_of(["doc_id", "text"], n))

    def asks(key, table):
        texts = read(table)
        found = find_runs(texts, length, k, n)
        return ask(key[0].as_py(), found, None if hot is None else sketch(texts, found, length, k))

    def narrowed(table, answers):
        texts = read(table)
        found = single_windows(texts, *shared_runs(find_runs(texts, length, k, n), answers), length, k, n)
        return texts, found, distinct(texts, found)

    def sends(key, table, answers):
        return send(key[0].as_py(), narrowed(table, answers)[2])

    def final(key, table, answers):
        # one side of the cogroup has both kinds of answer: bits, or which and masks
        kind = answers["which"].is_valid()
        texts, found, own = narrowed(table, answers.filter(pa.compute.invert(kind)))
        return finish(table, texts, covered(texts, found, own, answers.filter(kind), length))

    import pyarrow.compute  # noqa: F401

    asked, told_as = (ASK, ANSWER) if hot is None else (MARKED_ASK, MARKED_ANSWER)
    told = docs.groupBy("b").applyInArrow(asks, ddl(asked)).groupBy("g").applyInArrow(lambda table: answer_within(table, hot), ddl(told_as))
    sent = docs.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(sends, ddl(SEND))
    odd = sent.groupBy("g").applyInArrow(lambda table: exceptions(table, judge), ddl(EXCEPT))
    both = told.unionByName(odd, allowMissingColumns=True)
    return docs.groupBy("b").cogroup(both.groupBy("b")).applyInArrow(final, schema)
