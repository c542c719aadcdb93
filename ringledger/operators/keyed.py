"""Operators on keyed tables: first and last of a key, upserts, fill-only merges, slowly growing logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each key (DISTINCT ON for n = 1)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows of `delta` replace those of `base` with equal keys (nulls equal), others are added; of several, the first by `order`."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, keys, [F.col("_new").desc(), *order]).drop("_new")


def fill_only(base: DataFrame, delta: DataFrame, keys: Sequence[str], columns: Sequence[str], blank_is_null: bool = False) -> DataFrame:
    """`columns` of `base` keep their values; nulls are filled from `delta` (one row a key)."""
    new = delta.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = base.join(new, list(keys), "left")
    old = (lambda c: F.nullif(F.col(c), F.lit(""))) if blank_is_null else F.col
    return out.select(*(F.coalesce(old(c), F.col(f"_new_{c}")).alias(c) if c in columns else F.col(c) for c in base.columns))


def override(base: DataFrame, delta: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`columns` take the values of `delta` where it has any."""
    new = delta.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return base.join(new, list(keys), "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def merge_sources(primary: DataFrame, secondary: DataFrame, key: str, prefer_primary: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Full outer merge by key: preferred columns from the primary source, others from the secondary one, each filling the other's nulls."""
    p, s = primary.alias("p"), secondary.alias("s")
    joined = p.join(s, F.col(f"p.{key}") == F.col(f"s.{key}"), "full_outer")
    cols = [F.coalesce(F.col(f"p.{key}"), F.col(f"s.{key}")).alias(key)]
    cols += [F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}")).alias(c) for c in prefer_primary]
    cols += [F.coalesce(F.col(f"s.{c}"), F.col(f"p.{c}")).alias(c) for c in fill]
    origin = F.when(F.col(f"s.{key}").isNull(), "primary").when(F.col(f"p.{key}").isNull(), "secondary").otherwise("both")
    return joined.select(*cols, origin.alias("origin"))


def suppress_repeats(log: DataFrame, keys: Sequence[str], time: str, seconds: int, tie: str) -> DataFrame:
    """Drops a row if another one of the same keys was logged up to `seconds` before it."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    return log.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") > seconds * 1_000_000)).drop("_gap")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """All rows for which the condition is not true (rows where it is null stay)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that aren't there yet, as nulls of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
