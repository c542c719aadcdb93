"""Sequential ratings: each contest moves both sides' ratings, in order of (d, id).

A contest needs the current rating of both sides, so that contests of one connected component can't be parted. Ratings
run per component, each component's contests in order: Spark sorts them (on disk, if they are many) and a kernel of a
few microseconds a contest goes over them batch by batch, holding a few numbers for each side. Components come from the
links between sides (graph.py) or from a column. A component that holds nearly all contests is one task; beyond a few
hundred million contests in one component, rate by period and carry the ratings over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions.ratings import BASE, k_factor
from ringledger.operators import graph

OUT = "id long, d timestamp_ntz, a long, b long, ra double, rb double, expected double, change double, score double"
SIDE = ("entity", "opponent", "before", "opponent_before", "expected", "after", "change", "result")


# What a win or loss adds to form, how much of it and other shifts count, and the bounds of an enhanced expectation.
FORM, SHARE, LOW, HIGH = {"win": 0.02, "loss": -0.02, "draw": 0.0}, 0.5, 0.05, 0.95
OTHER = {"draw": "draw", "win": "loss", "loss": "win"}
#: Microseconds.
DAY = 86_400_000_000


def form(results: list[str]) -> float:
    """Of the last three results, the latest one counts whole, the others a half and a third."""
    return sum(FORM[x] / (i + 1) for i, x in enumerate(reversed(results[-3:])))


def run_contests(batches: Iterator[pa.RecordBatch], enhanced: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each contest: id, d, a, b, ratings before, expectation, change and score of side a.

    Batches have the columns _g, id, d, a, b, score, k, shift_a and shift_b, sorted by _g, d and id. What is kept is a component's last ratings, not its contests.
    """
    component, rating, last, past = None, {}, {}, {}
    for batch in batches:
        before_a, before_b, expectations, changes = [], [], [], []
        columns = [batch.column(c) for c in ("_g", "d", "a", "b", "score", "k", "shift_a", "shift_b")]
        columns[1] = columns[1].cast(pa.int64())
        for g, t, a, b, score, k, shift_a, shift_b in zip(*(c.to_pylist() for c in columns), strict=True):
            if g != component:
                component, rating, last, past = g, {}, {}, {}
            for x in (a, b):
                since = last.get(x)
                if since is not None and t is not None:
                    years = (t - since) // DAY / 365
                    if years > 0.5:
                        rating[x] -= (rating[x] - BASE) * 0.1 * years
            ra, rb = rating.get(a, BASE), rating.get(b, BASE)
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            if enhanced:  # seen from the winner's side, of a draw from the first side
                first = score > 0
                more = (shift_a if first else shift_b) + form(past.get(a if first else b, []))
                seen = max(LOW, min(HIGH, (expected if first else 1 - expected) + SHARE * more))
                expected = seen if first else 1 - seen
                kind = "draw" if score == 0.5 else "win" if score else "loss"
                for x, result in ((a, kind), (b, OTHER[kind])):
                    past[x] = [*past.get(x, ())[-2:], result]
            change = k * (score - expected)
            rating[a], rating[b] = ra + change, rb - change
            last[a] = last[b] = t
            before_a.append(ra)
            before_b.append(rb)
            expectations.append(expected)
            changes.append(change)
        made = [pa.array(x, pa.float64()) for x in (before_a, before_b, expectations, changes)]
        yield pa.record_batch([*(batch.column(c) for c in ("id", "d", "a", "b")), *made, batch.column("score")], names=[x.split()[0] for x in OUT.split(", ")])


def both_sides(rated: DataFrame) -> DataFrame:
    """Both sides' history rows of each rated contest."""
    kind = F.when(F.col("score") == 0.5, "draw").when(F.col("score") > 0, "win").otherwise("loss")
    other = F.when(F.col("score") == 0.5, "draw").when(F.col("score") > 0, "loss").otherwise("win")
    a = (F.col("a"), F.col("b"), F.col("ra"), F.col("rb"), F.col("expected"), F.col("ra") + F.col("change"), F.col("change"), kind)
    b = (F.col("b"), F.col("a"), F.col("rb"), F.col("ra"), 1 - F.col("expected"), F.col("rb") - F.col("change"), -F.col("change"), other)
    sides = (F.struct(*(x.alias(n) for x, n in zip(side, SIDE, strict=True))) for side in (a, b))
    return rated.select("id", F.col("d").cast("timestamp").alias("d"), F.inline(F.array(*sides)))


def rate(contests: DataFrame, component: str | None = None, enhanced: bool = False) -> DataFrame:
    """History of ratings. contests: id, d, a, b, winner and optionally kind, method, round.

    Enhanced ratings move the expectation of the winner by its form and by shift_a or shift_b (columns of the contest:
    age, reach and style, as enhanced_shift() gives them).
    """
    has = lambda c, t: F.col(c) if c in contests.columns else F.lit(None).cast(t)
    k = k_factor(has("kind", "string"), has("method", "string"), has("round", "int"))
    shifts = [F.coalesce(has(c, "double"), F.lit(0.0)).alias(c) for c in ("shift_a", "shift_b")]
    rows = contests
    if component is None:
        found = graph.components(contests.select("a", "b"))
        rows = contests.join(found.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("a") == F.col("_node"))
    score = F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col("a"), 1.0).otherwise(0.0)
    ids = [F.col(c).cast("long").alias(c) for c in ("id", "a", "b")]
    ready = rows.select(F.col(component or "_root").alias("_g"), *ids, F.col("d").cast("timestamp_ntz").alias("d"), score.alias("score"), F.coalesce(k, F.lit(32.0)).alias("k"), *shifts)
    one = ready.repartition("_g").sortWithinPartitions("_g", F.col("d").asc_nulls_last(), "id")
    return both_sides(one.mapInArrow(lambda x: run_contests(x, enhanced), OUT))


def peaks(history: DataFrame) -> DataFrame:
    """Last and highest rating of every entity."""
    return history.groupBy("entity").agg(F.max_by("after", F.struct("d", "id")).alias("rating"), F.max("after").alias("peak"), F.count("*").alias("n"))
