"""One place that says which session settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", app: str = "ringledger", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session to every operator instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("RINGLEDGER_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RINGLEDGER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
