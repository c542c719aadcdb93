"""As-of and latest-row lookups as windows over a union: one shuffle by key, no inequality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], tie: str, strict: bool = True) -> DataFrame:
    """For each row of `left`, `values` of the latest row of `right` with the same key and an earlier (or, unless strict,
    equal) time; of equal times, the one with the largest `tie`. Columns of `left` plus the values; no match gives nulls.
    """
    packed = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"), *values)
    side_right = right.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0 if not strict else 1).alias("_side"), packed.alias("_right"), F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_left"))
    side_left = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1 if not strict else 0).alias("_side"), F.lit(None).cast(side_right.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left"))
    until = Window.partitionBy("_k").orderBy("_t", "_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = side_left.unionByName(side_right).withColumn("_best", F.max("_right").over(until))
    return seen.filter("_left is not null").select("_left.*", *(F.col(f"_best.{v}").alias(f"asof_{v}") for v in values))


def latest(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key: an aggregate, so that a hot key is reduced before the shuffle."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(key, "_last.*")
