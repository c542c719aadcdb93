"""Running totals over all rows without sorting them in one task (DataFrame functions only).

Rows fall into buckets by a hash; the totals of buckets are summed up in order, and each bucket adds its own rows to
what stands before it. Buckets hold a few thousand rows whatever the input's size, also where one source or copy has
a third of all rows, for the hash covers the row's id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_IN_BUCKET = 5000


def bucket_count(rows: int) -> int:
    return max(1, -(-rows // ROWS_IN_BUCKET))


def row_hash(id_col: Column, text_col: Column, seed: int) -> Column:
    return F.xxhash64(id_col, text_col, F.lit(seed))


def before(rows: DataFrame, totals_from: DataFrame, keys: list[str], value: str, order: list[str], out: str, about: DataFrame | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that stand before, in the order of (bucket, *order).

    Both frames have the keys, `bucket` and `value`; `totals_from` has the same rows as `rows` but may be slimmer.
    `about` has more columns for each combination of the keys, named _k_<key>; they come along with the totals of
    buckets, so that `rows` is shuffled once, by keys and bucket, and never by a hot key alone.
    """
    sums = totals_from.groupBy(*keys, "bucket").agg(F.sum(value).alias("_of_bucket"))
    above = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_of_bucket").over(above), F.lit(0)).alias("_above"))
    if about is not None:
        both = about.select(*(F.col(f"_k_{k}").alias(f"_a_{k}") for k in keys), *(c for c in about.columns if c not in [f"_k_{k}" for k in keys]))
        match = F.lit(True)
        for k in keys:
            match = match & F.col(f"_k_{k}").eqNullSafe(F.col(f"_a_{k}"))
        sums = sums.join(both, match, "left").drop(*(f"_a_{k}" for k in keys))
    same = F.col("bucket") == F.col("_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, same, "left")
    return joined.withColumn(out, F.col("_above") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_above", *(f"_k_{k}" for k in keys))
