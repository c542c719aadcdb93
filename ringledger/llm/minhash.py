"""One-permutation MinHash with optimal densification, on many sets at once.

One hash of each member picks a bin (high bits) and a value; a bin keeps its smallest value. An empty bin borrows from
a bin that its own random sequence of places, the same for all sets, meets first: so the chance that two sets agree in
a bin stays their Jaccard similarity, also for small sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ringledger.llm.common import U64, mix

EMPTY = np.iinfo(np.uint32).max
#: Values of a row that is filled without tries.
FEW = 16


def places(bins: int, attempt: int) -> np.ndarray:
    """Where each bin looks at its `attempt`-th try."""
    return (mix(np.arange(bins, dtype=U64) * U64(0x1000003) + U64(attempt * 0x9E3779B1 + 12345)) % U64(bins)).astype(np.int64)


def least_values(names: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n rows of `bins` values: a well mixed name picks the bin by its high half and competes with its low half."""
    slot = names >> U64(32)
    slot *= U64(bins)
    slot >>= U64(32)
    slot = slot.view(np.int64)
    slot += owner * bins
    out = np.full(n * bins, EMPTY, np.uint32)
    np.minimum.at(out, slot, names.astype(np.uint32))
    return out.reshape(n, bins)


@lru_cache(maxsize=8)
def meetings(bins: int) -> np.ndarray:
    """At which try the second bin's sequence first meets the first bin; -1 for a bin with itself."""
    out = np.full((bins, bins), -1, np.int32)
    met, every, attempt = np.eye(bins, dtype=bool), np.arange(bins), 0
    while not met.all():
        attempt += 1
        at = places(bins, attempt)
        new = ~met[at, every]
        out[at[new], every[new]], met[at, every] = attempt, True
    return out


def densify(values: np.ndarray) -> np.ndarray:
    """Fills the empty bins of every row that has any value, in place."""
    n, bins = values.shape
    empty = values == EMPTY
    filled = bins - np.count_nonzero(empty, axis=1)
    for k in range(1, min(FEW, bins - 1) + 1):  # rows with few values need many tries: all k sources at once instead
        rows = np.flatnonzero(filled == k)
        for at in range(0, len(rows), 200):
            some = rows[at : at + 200]
            source = np.nonzero(~empty[some])[1].reshape(-1, k)
            first = meetings(bins)[source].argmin(axis=1)
            values[some] = np.take_along_axis(values[some], np.take_along_axis(source, first, 1), 1)
    own = values.ravel().copy()
    flat = values.reshape(-1)
    place = np.flatnonzero(empty & (filled > FEW)[:, None])
    column = place % bins
    attempt = 0
    while len(place):
        attempt += 1
        found = own[place + (places(bins, attempt) - np.arange(bins))[column]]
        hit = found != EMPTY
        flat[place[hit]] = found[hit]
        left = ~hit
        place, column = place[left], column[left]
    return values


def signatures(hashes: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """A row of `bins` values for each set; set i has the members hashes[first[i] : first[i + 1]]. Empty sets get EMPTY."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    return densify(least_values(mix(hashes ^ U64(0x5851F42D4C957F2D)), owner, n, bins))


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of `rows` neighbouring bins; the band's number is part of it."""
    n, bins = signature.shape
    part = signature.reshape(n, bins // rows, rows)
    out = np.broadcast_to(mix(np.arange(bins // rows, dtype=U64) + U64(77)), part.shape[:2]).copy()
    for j, odd in enumerate((mix(np.arange(rows, dtype=U64) + U64(1077)) | U64(1)).tolist()):  # a sum by random odd weights, mixed once
        out += part[:, :, j] * U64(odd)
    return mix(out)
