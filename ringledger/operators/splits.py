"""Splits by time, samples by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: Sequence[str], out: str, total: str | None = None) -> DataFrame:
    """Adds `out`, the place of each row in order (from 1), and on demand the number of rows.

    Places come from counts of the order's days, so that no single task sorts all rows: a day's rows are ranked in its
    own window, on top of the rows of all days before. Rows without a day come first.
    """
    day = F.to_date(order[0])
    per_day = df.groupBy(day.alias("_day")).agg(F.count("*").alias("_rows"))
    above = per_day.select(F.col("_day").alias("_d"), F.coalesce(F.sum("_rows").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"), F.sum("_rows").over(Window.partitionBy()).alias("_total"))
    ranked = df.join(above, day.eqNullSafe(F.col("_d"))).withColumn(out, F.col("_above") + F.row_number().over(Window.partitionBy("_d").orderBy(*order)))
    return (ranked.withColumnRenamed("_total", total) if total else ranked.drop("_total")).drop("_d", "_above")


def by_position(df: DataFrame, order: Sequence[str], cuts: Sequence[tuple[str, float]]) -> DataFrame:
    """Adds `part`: rows in order fall into the named parts with the given cumulative shares, e.g. (("train", .7), ("val", .85), ("holdout", 1))."""
    ranked = numbered(df, order, "_rank", "_total")
    part = F.lit(cuts[-1][0])
    for name, share in reversed(cuts[:-1]):
        part = F.when(F.col("_rank") <= F.floor(F.col("_total") * share), F.lit(name)).otherwise(part)
    return ranked.withColumn("part", part).drop("_total", "_rank")


def folds(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """Adds `block` 1 to n + 1 in time; fold k trains on blocks up to k and tests on block k + 1."""
    cuts = [(str(i + 1), (i + 1) / (n + 1)) for i in range(n + 1)]
    return by_position(df, order, cuts).withColumn("block", F.col("part").cast("int")).drop("part")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same ones at every run: the smallest md5 of (seed, key)."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def swapped_by_hash(key: str, seed: int = 42) -> Column:
    """A coin for each key, the same at every run."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 1) < F.lit("8")
