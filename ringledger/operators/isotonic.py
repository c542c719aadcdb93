"""Isotonic regression by pool-adjacent-violators in levels, so that no task ever holds all points.

Points are first merged by score (a score that a third of all rows has costs one row a task). Scores are dealt into
ranges; each range is pooled to its blocks in one pass; blocks of neighbouring ranges are pooled again in fewer ranges,
and so on to one. Pooling blocks gives the same as pooling points, because a violator within a range stays one.
Blocks have distinct rising rates: n points of zeros and ones have some n ** (2 / 3) of them at most, a few hundred as a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.sources.files import stored

BLOCKS = "lo double, hi double, n double, s double"
#: Distinct scores of a range, and how many ranges become one.
ROWS, FAN = 200_000, 32


class Pool:
    """Blocks from the lowest score on; a block that isn't above the one before joins it."""

    def __init__(self) -> None:
        self.lo, self.hi, self.n, self.s = [], [], [], []

    def add(self, lo: float, hi: float, n: float, s: float) -> None:
        while self.n and self.s[-1] * n >= s * self.n[-1]:  # not above: rates compared without dividing
            lo, n, s = self.lo.pop(), n + self.n.pop(), s + self.s.pop()
            self.hi.pop()
        self.lo.append(lo)
        self.hi.append(hi)
        self.n.append(n)
        self.s.append(s)


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool = Pool()
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            pool.add(*row)
    yield pa.record_batch([pa.array(x, pa.float64()) for x in (pool.lo, pool.hi, pool.n, pool.s)], names=["lo", "hi", "n", "s"])


def blocks(points: DataFrame, score: str = "p", label: str = "label", rows: int = ROWS, fan: int = FAN) -> DataFrame:
    """lo, hi, n (points), s (sum of labels) of each block; rows without score or label are left out."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    each = points.filter(p.isNotNull() & ~F.isnan(p) & y.isNotNull()).groupBy(p.alias("lo")).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("s"))
    now = stored(each.select("lo", F.col("lo").alias("hi"), "n", "s"))
    ranges = max(1, -(-now.count() // rows))
    while True:
        now = stored(now.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInArrow(pooled, BLOCKS))
        if ranges == 1:
            return now
        ranges = -(-ranges // fan)


class Calibrator:
    """A rising function of the score: each block's rate over the block, straight lines between blocks, level outside."""

    def __init__(self, x: list[float], y: list[float]):
        self.x, self.y = x, y

    @classmethod
    def fit(cls, points: DataFrame, score: str = "p", label: str = "label", **sizes: int) -> Calibrator:
        rows = blocks(points, score, label, **sizes).orderBy("lo").collect()
        x, y = [], []
        for r in rows:
            for at in (r["lo"], r["hi"]) if r["hi"] > r["lo"] else (r["lo"],):
                x.append(at)
                y.append(r["s"] / r["n"])
        return cls(x, y)

    def __call__(self, score: Column, low: float = 0.0, high: float = 1.0) -> Column:
        """Calibrated probability, held within low and high; null for a null score or without any point to learn from."""
        if not self.x:
            return F.lit(None).cast("double")
        x, y = np.array(self.x), np.array(self.y)

        @F.pandas_udf("double")
        def interpolated(s: pd.Series) -> pd.Series:
            return pd.Series(np.interp(s.to_numpy(float), x, y)).where(s.notna().to_numpy())

        return F.when(score.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), interpolated(score.cast("double")))))
