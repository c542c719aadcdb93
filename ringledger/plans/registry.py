"""Names every query of the engine and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringledger.plans import aggregates, domain, joins, modeling, names, ordering, prediction, projections, scalars, scans, stateful, storage, streams, windows

Query = Callable[[SparkSession, str], DataFrame]

MODULES: list = [scans.M, projections.M, joins.M, aggregates.M, windows.M, ordering.M, scalars.M, domain.M, prediction.M, modeling.M, names.M, storage.M, stateful.M, streams.M]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(module.SQL)
    return found


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """History features of both sides of every contest, by region."""
    return domain.flagship(spark, folder)
