"""Operator 2, mixing sources to target weights: a curriculum whose source weights change over training.

Every source has a schedule, its weight at each moment of training (piecewise linear over 0 to 1). The integral of the
schedule, scaled to the source's target, is the demand for its words up to a moment. The documents of a source lie one
after the other on that axis, in an order given by a hash, and again for a second pass where the target asks for it;
inverting the demand at a document's start gives the moment at which it is read. A final range sort by that position
is the training order. DataFrame functions only.

Targets: the budget is a share of all words, dealt out by weight; a source gets at most `cap` times its size, and the
excess goes to the others by weight until none is above (found in one pass over the sources sorted by cap over weight:
the level to which weights are filled is the largest of the levels that each prefix of capped sources leaves).

Defined cases: a null text or one without words has size 0 and is never taken; a null source is a source, the last;
repeated rows are rows of their own; a null id is an id; other columns are carried along; no rows give no rows.
The last copy that the target cuts is taken in part: `words` says how many of its words.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.llm.common import WORD, stored
from ringledger.llm.numbering import before, bucket_count, row_hash

Schedule = Sequence[tuple[float, float]]
#: Early, steady and late sources, in turn.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.8), (1.0, 1.9)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target, turn (0-based place of the source in the cycle of schedules)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("turn", F.row_number().over(by_name) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("turn") % len(weights) + 1).cast("int")))
    each = each.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    tight = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    capped = F.coalesce(F.sum("most").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - capped) / left)
    each = each.withColumn("target", F.least(F.col("most"), F.col("weight") * F.max("level").over(every)))
    return each.select("source", "source_size", "target", "turn")


def moment(turn: Column, done: Column, schedules: Sequence[Schedule]) -> Column:
    """Where in training the share `done` of a source's demand is reached: the inverse of the schedule's integral."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        areas = [0.0]
        for (t0, m0), (t1, m1) in pairwise(knots):
            areas.append(areas[-1] + (t1 - t0) * (m0 + m1) / 2)
        y = done * areas[-1]
        here = F.lit(float(knots[-1][0]))
        for j in range(len(knots) - 2, -1, -1):
            (t0, m0), (t1, m1) = knots[j], knots[j + 1]
            rest = F.greatest(y - areas[j], F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(m0 * m0) + 2 * (m1 - m0) / (t1 - t0) * rest, F.lit(0.0)))
            step = F.coalesce(F.try_divide(2 * rest, root + m0), F.lit(0.0))
            here = F.when(y < areas[j + 1], F.lit(float(t0)) + step).otherwise(here)
        out = F.when(turn % len(schedules) == i, here).otherwise(out)
    return out


def assign(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, schedules: Sequence[Schedule] = SCHEDULES, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, source_size, target and `copies`, an array of (epoch, position, words).

    With `carry`, the column `row` holds the whole input row.
    """
    id_, source, text = F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col)
    whole = F.struct("*").alias("row")
    n = bucket_count(docs.count())
    sized = docs.select(id_, source, word_count(text).alias("size"), row_hash(F.col(id_col), text, seed).alias("h"), *([whole] if carry else []))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(n)))
    slim = stored(sized.drop("row"))
    goals = targets(slim, weights, share, cap).withColumnRenamed("source", "_k_source")
    rows = before(sized if carry else slim, slim, ["source"], "size", ["h", "doc_id", "size"], "start", about=goals)
    epochs = max(1, -(-int(cap * 1000) // 1000))
    budget = F.floor("target")

    def copy(e: int) -> Column:
        begin = F.col("start") + F.lit(e) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), budget - begin)).cast("long")
        return F.struct(F.lit(e).alias("epoch"), moment(F.col("turn"), begin / F.col("target"), schedules).alias("position"), words.alias("words"))

    copies = F.filter(F.array(*(F.when((F.col("size") > 0) & (F.col("target") > 0), copy(e)) for e in range(epochs))), lambda c: c["words"] > 0)
    return rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *(["row"] if carry else []))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: a row of `docs` for each copy taken, range-sorted by training position (columns as in `docs`)."""
    taken = assign(docs, carry=True, **options)
    each = taken.select("row", F.explode("copies").alias("copy"), "doc_id")
    return each.orderBy("copy.position", "doc_id", "copy.epoch").select("row.*")
