"""Data-quality rules: named conditions, counted in one pass, and constraints between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (a rule that is null is not broken)."""
    one = df.agg(*(F.count_if(~condition).alias(name) for name, condition in rules.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))))


def warnings_of(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row for each broken rule of each row; rows are never dropped by it."""
    said = F.array_compact(F.array(*(F.when(~condition, F.lit(name)) for name, condition in rules.items())))
    return df.select(*keys, F.explode(said).alias("rule"))


def valid_and_rejected(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose required columns all hold text, and the others."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return df.filter(ok), df.filter(~ok)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of `child` whose key isn't in `parent` (foreign key check)."""
    return child.join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def coverage(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """n, covered and percent of rows that have a partner."""
    known = other.select(F.col(other_key).alias("_o")).distinct().withColumn("_hit", F.lit(1))
    joined = df.join(known, F.col(key) == F.col("_o"), "left")
    return joined.agg(F.count("*").alias("n"), F.count("_hit").alias("covered")).withColumn("percent", F.try_divide(100.0 * F.col("covered"), F.col("n")))
