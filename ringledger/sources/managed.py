"""Tables that a schema names: made, rebuilt, emptied, migrated. Each schema lives below a folder of its own in shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.sources.files import scratch


def apply_schema(spark: SparkSession, schema: Mapping[str, str], prefix: str | None = None) -> dict[str, str]:
    """Drops and makes every table, empty; gives the full name of each."""
    prefix, folder = prefix or f"t{uuid.uuid4().hex}", scratch(spark)
    made = {}
    for name, columns in schema.items():
        made[name] = f"{prefix}_{name}"
        spark.sql(f"DROP TABLE IF EXISTS {made[name]}")
        spark.sql(f"CREATE TABLE {made[name]} ({columns.replace('long', 'bigint')}) USING parquet LOCATION '{folder}/{name}'")
    return made


def rebuild(rows: DataFrame, name: str) -> None:
    """Replaces all rows of a table."""
    rows.write.insertInto(name, overwrite=True)


def children_first(points_to: Mapping[str, Sequence[str]]) -> list[str]:
    """Tables in an order in which each comes before those that it points to."""
    return list(TopologicalSorter(points_to).static_order())[::-1]


def clear(spark: SparkSession, made: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Empties the tables in order; step, name and the rows left in each."""
    done = []
    for step, name in enumerate(order, 1):
        rebuild(spark.createDataFrame([], spark.table(made[name]).schema), made[name])
        done.append((step, name, spark.table(made[name]).count()))
    return spark.createDataFrame(done, "step int, name string, left_over long")


def report(spark: SparkSession, made: Mapping[str, str]) -> DataFrame:
    """name, rows and number of columns of each table."""
    return spark.createDataFrame([(k, spark.table(v).count(), len(spark.table(v).columns)) for k, v in made.items()], "name string, n long, columns int")


def migrate(rows: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns that aren't there yet, each with its kind and default."""
    return rows.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in columns.items() if c not in rows.columns})


def run_steps(steps: Mapping[str, tuple[int, Callable[[], object]]]) -> list[tuple[int, str, str]]:
    """Runs steps by priority until one fails: (priority, name, state)."""
    out, failed = [], False
    for name, (priority, step) in sorted(steps.items(), key=lambda x: x[1][0]):
        state = "not run"
        if not failed:
            try:
                step()
                state = "done"
            except Exception:
                state, failed = "failed", True
        out.append((priority, name, state))
    return out
