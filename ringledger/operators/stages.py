"""Stages in order of priority, with restart: each stage's table is stored, and a manifest says which ones are finished.

A stage is finished for an input: the manifest holds a hash of the sources' rows, the stage's name, priority and revision
and those of all stages before it. A run takes what is finished from shared storage and starts with the first stage that
isn't; a stage that fails stops the run and leaves the earlier ones finished.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.sources import pointers


@dataclass(frozen=True)
class Stage:
    """make(tables) gives the stage's table; tables has the sources and the tables of earlier stages by name."""

    name: str
    priority: int
    make: Callable[[Mapping[str, DataFrame]], DataFrame]
    revision: str = "1"


def fingerprint(df: DataFrame) -> str:
    """Number and hash of all rows, whatever their order: one aggregate without a shuffle of rows."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{df.schema.simpleString()}|{row['n']}|{row['h']}"


def run(spark: SparkSession, home: str, stages: Sequence[Stage], sources: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], list[tuple[int, str, str]]]:
    """Tables by name, and (priority, name, state) for each stage: done, kept (finished before), failed or not run."""
    text = pointers.read(spark, f"{home}/manifest.json")
    manifest: dict[str, dict] = json.loads(text) if text else {}
    said = hashlib.sha256()
    for name in sorted(sources):
        said.update(f"{name}={fingerprint(sources[name])};".encode())
    tables, log, failed = dict(sources), [], False
    for stage in sorted(stages, key=lambda s: (s.priority, s.name)):
        said.update(f"{stage.priority}|{stage.name}|{stage.revision};".encode())
        key = said.hexdigest()
        state = "not run"
        if not failed:
            path = f"{home}/{stage.name}/{key}"
            state = "kept"
            try:
                if manifest.get(stage.name, {}).get("key") != key:
                    stage.make(tables).write.mode("overwrite").parquet(path)
                    manifest[stage.name] = {"key": key, "path": path}
                    pointers.replace(spark, f"{home}/manifest.json", json.dumps(manifest))
                    state = "done"
                tables[stage.name] = spark.read.parquet(path)
            except Exception as e:
                state, failed = f"failed: {type(e).__name__}", True
        log.append((stage.priority, stage.name, state))
    return tables, log
