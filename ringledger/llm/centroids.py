"""Operator 12, centroid clustering (Lloyd's iteration) with Elkan's bounds, exact in integers.

Component x of a vector becomes floor(scale * x). Centroids start as the kept vectors with the smallest SHA-256 of
`<seed>:<vec_id>`, in that order. A round assigns every vector to its nearest centroid (squared distance; ties: the
smaller number) and moves non-empty centroids to the floor of their vectors' mean; empty ones stay. Vectors are assigned
once more at the end.

Bounds. A vector carries its cluster, an upper bound of the distance to that centroid, and a lower bound of the distance
to each of the k centroids. Bounds follow the centroids' moves. A distance is not computed if the upper bound is strictly
below the lower bound, or strictly below half the distance between the two centroids: then the other centroid is truly
farther, so that ties are always computed. Roots, halves and moves are rounded away from the tight side, so that rounding
can only cost a computation. What decides is always an exact integer distance.

A round is one pass without shuffle over the vectors with their bounds, which the pass before has written (and which is
deleted when the next one has been); centroids are k rows, sums k rows a task, added up on the executors.

Defined cases: vectors that are null, of another size, or with a null or non-finite component have no row; repeated rows
are rows of their own; a null id hashes to null and comes last among the starting vectors; equal ids are ordered by their
components; fewer vectors than k give so many clusters; no rows give no rows; other columns are ignored. A component of
2**27 or more after scaling raises an error: squared distances would leave 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import dropped, raw_strings, slices, stored

LARGEST = 1 << 27
#: Vectors of a batch that are worked on at once.
ROWS = 4096
STATE = "vec_id long, v binary, cluster int, upper double, lower binary"


def whole_vectors(vectors: DataFrame, size: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (packed long integers) of the vectors that are kept."""
    x = F.col("x")
    finite = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x")).filter(x.isNotNull() & finite)

    def run(batches):
        for batch in slices(batches, ROWS):
            column = batch.column(1)
            flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(flat) and np.abs(flat).max() >= LARGEST:
                raise ValueError(f"a scaled component reaches {LARGEST}: squared distances would leave 64 bits")
            data = flat.astype(np.int64).tobytes()
            yield pa.record_batch([batch.column(0), pa.array([data[i : i + 8 * size] for i in range(0, len(data), 8 * size)], pa.binary())], names=["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id long, v binary")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([np.frombuffer(r["v"], np.int64) for r in rows])


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def root_above(squares: np.ndarray) -> np.ndarray:
    """Not less than the true root of whole numbers (they may not fit a double exactly)."""
    return up(up(np.sqrt(squares.astype(np.float64))))


def root_below(squares: np.ndarray) -> np.ndarray:
    return np.maximum(down(down(np.sqrt(squares.astype(np.float64)))), 0.0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return np.square(x - y).sum(axis=-1)


class Step:
    """One assignment: the centroids, how far each has moved, and half of the distances between them (rounded down)."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now = now
        self.moved = None if before is None else root_above(squared(now, before))
        self.half = root_below(squared(now[:, None, :], now[None, :, :])) / 2
        others = self.half.copy()
        np.fill_diagonal(others, np.inf)
        self.nearest = others.min(axis=1)

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower bounds of vectors without any."""
        each = np.stack([squared(v, c) for c in self.now], axis=1)
        cluster = each.argmin(axis=1)  # the first of equal ones
        return cluster, root_above(each[np.arange(len(v)), cluster]), root_below(each)

    def again(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after the centroids' move, with as few distances as the bounds allow."""
        cluster, upper = cluster.copy(), up(upper + self.moved[cluster])
        lower = np.maximum(down(lower - self.moved), 0.0)
        exact = np.full(len(v), -1, np.int64)  # squared distance to the own centroid, where it is known

        def tighten(rows):
            rows = rows[exact[rows] < 0]
            exact[rows] = squared(v[rows], self.now[cluster[rows]])
            upper[rows] = root_above(exact[rows])
            lower[rows, cluster[rows]] = root_below(exact[rows])

        open_rows = np.flatnonzero(~(upper < self.nearest[cluster]))
        for j in range(len(self.now)):
            def asks(rows, j=j):
                own = cluster[rows]
                return rows[(own != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < self.half[own, j])]

            rows = asks(open_rows)
            if not len(rows):
                continue
            tighten(rows)
            rows = asks(rows)
            if not len(rows):
                continue
            there = squared(v[rows], self.now[j])
            lower[rows, j] = root_below(there)
            better = (there < exact[rows]) | ((there == exact[rows]) & (j < cluster[rows]))
            to = rows[better]
            cluster[to], exact[to], upper[to] = j, there[better], root_above(there[better])
        return cluster, upper, lower


def assigned(state: DataFrame, step: Step, size: int) -> DataFrame:
    """The vectors with the clusters and bounds that `step` gives; `state` has bounds but before the first one."""
    k = len(step.now)
    begun = "cluster" in state.columns

    def run(batches):
        for batch in slices(batches, ROWS):
            v = raw_strings(batch.column(1))[0].view(np.int64).reshape(-1, size)
            if begun:
                lower = raw_strings(batch.column(4))[0].view(np.float64).reshape(-1, k)
                cluster, upper, lower = step.again(v, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), lower)
            else:
                cluster, upper, lower = step.first(v)
            data = lower.tobytes()
            packed = pa.array([data[i : i + 8 * k] for i in range(0, len(data), 8 * k)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), packed], names=["vec_id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids' next places: floors of exact means."""
    k, size = now.shape

    def sums(batches):
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = raw_strings(batch.column(0))[0].view(np.int64).reshape(-1, size)
            cluster = batch.column(1).to_numpy()
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    each = state.select("v", "cluster").mapInArrow(sums, "cluster int, n long, total array<long>")
    each = each.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)))
    out = now.copy()
    for row in each.collect():  # k rows at most
        out[row["cluster"]] = [row[f"t{i}"] // row["n"] for i in range(size)]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long) for each vector that is kept."""
    state = stored(whole_vectors(vectors, size, scale, id_col, vec_col))
    now = first_centroids(state, k, seed)
    if not len(now):
        return state.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.array(F.lit(0).cast("long")).alias("centroid")).limit(0)
    before = None
    for turn in range(rounds + 1):
        last, state = state, stored(assigned(state, Step(now, before), size))
        dropped(last)
        if turn < rounds:
            before, now = now, moved(state, now)
    final = now

    def distances(batches):
        for batch in slices(batches, ROWS):
            v = raw_strings(batch.column(1))[0].view(np.int64).reshape(-1, size)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(squared(v, final[batch.column(2).to_numpy()]), pa.int64())], names=["vec_id", "cluster", "distance"])

    rows = state.select("vec_id", "v", "cluster").mapInArrow(distances, "vec_id long, cluster int, distance long")
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    told = [(c, d, sum(sums.values()), final[c].tolist()) for c, d in sums.items()]
    clusters = vectors.sparkSession.createDataFrame(told, "_c int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(clusters), F.col("cluster") == F.col("_c")).drop("_c")


def centroid_names(rows: DataFrame) -> DataFrame:
    """The same with centroid_sha256, the hash of a centroid's components joined by commas, in place of centroid."""
    return rows.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")

