"""Model bundles in shared storage: versions of a fitted pipeline with what prediction needs besides, and one pointer.

A version is a folder with the pipeline and metadata.json (feature order, clipping bounds, medians, dropped features,
calibration, metrics, versions of the software). It is complete before the pointer LATEST moves to it, in one step: who
loads sees the old version or the new one.
"""

from __future__ import annotations

import json
import platform
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.operators import ranks
from ringledger.operators.isotonic import Calibrator
from ringledger.sources import pointers


@dataclass(frozen=True)
class Preparation:
    """Bounds and medians of the training rows, for each feature in the model's order."""

    features: tuple[str, ...]
    bounds: Mapping[str, tuple[float, float]]
    medians: Mapping[str, float]

    @classmethod
    def of(cls, train: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99) -> Preparation:
        row = ranks.percentiles(train, {f"{c}_{n}": (c, q) for c in features for n, q in (("lo", low), ("hi", high), ("median", 0.5))}).first()
        bounds = {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in features if row[f"{c}_lo"] is not None}
        return cls(tuple(features), bounds, {c: 0.0 if row[f"{c}_median"] is None else float(row[f"{c}_median"]) for c in features})

    def apply(self, rows: DataFrame) -> DataFrame:
        """Features clipped to the bounds, missing ones (also columns that aren't there) filled with the median."""
        ready = {}
        for c in self.features:
            x = F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
            x = F.when(F.isnan(x), F.lit(None)).otherwise(x)
            if c in self.bounds:
                low, high = self.bounds[c]
                x = F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))
            ready[c] = F.coalesce(x, F.lit(self.medians.get(c, 0.0)))
        return rows.withColumns(ready)


@dataclass(frozen=True)
class Bundle:
    version: str
    model: Model
    preparation: Preparation
    calibrator: Calibrator
    metadata: Mapping[str, object] = field(default_factory=dict)

    def predict(self, rows: DataFrame) -> DataFrame:
        """`rows` with raw_p (the model's) and p (calibrated, held within 0.10 and 0.90)."""
        keep = [c for c in rows.columns if c not in ("raw_p", "p")]
        kept = rows.select(F.struct(*keep).alias("_row"), *(F.col(c) for c in self.preparation.features if c in rows.columns))
        out = self.model.transform(self.preparation.apply(kept)).select("_row.*", vector_to_array("probability")[1].alias("raw_p"))
        return out.withColumn("p", self.calibrator(F.col("raw_p"), 0.10, 0.90))


def save(spark: SparkSession, folder: str, model: PipelineModel, preparation: Preparation, calibrator: Calibrator, name: str = "v3", dropped: Sequence[str] = (), metrics: Mapping[str, float] | None = None, **more: object) -> str:
    """Writes a new version and moves the pointer to it; gives the version's name."""
    version = f"{name}_{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    at = f"{folder}/versions/{version}"
    model.write().save(f"{at}/model")
    metadata = {
        "version": version, "features": list(preparation.features), "bounds": {k: list(v) for k, v in preparation.bounds.items()}, "medians": dict(preparation.medians),
        "dropped": list(dropped), "calibration": {"x": calibrator.x, "y": calibrator.y}, "metrics": dict(metrics or {}), "saved_at": datetime.now(UTC).isoformat(),
        "spark": spark.version, "python": platform.python_version(), **more,
    }
    pointers.replace(spark, f"{at}/metadata.json", json.dumps(metadata, indent=1))
    pointers.replace(spark, f"{folder}/LATEST", version)
    return version


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions, the oldest first."""
    return [v for v in pointers.children(spark, f"{folder}/versions") if pointers.read(spark, f"{folder}/versions/{v}/metadata.json") is not None]


def load(spark: SparkSession, folder: str, version: str | None = None, features: Sequence[str] | None = None) -> Bundle:
    """The version that the pointer names, or another one. Refuses a bundle whose features or their order aren't those that the caller makes."""
    version = version or pointers.read(spark, f"{folder}/LATEST")
    if version is None:
        raise FileNotFoundError(f"no bundle in {folder}")
    text = pointers.read(spark, f"{folder}/versions/{version}/metadata.json")
    if text is None:
        raise FileNotFoundError(f"{folder} has no complete version {version}")
    m = json.loads(text)
    if features is not None and list(features) != m["features"]:
        raise ValueError(f"version {version} takes {m['features']}, not {list(features)}")
    preparation = Preparation(tuple(m["features"]), {k: tuple(v) for k, v in m["bounds"].items()}, m["medians"])
    return Bundle(version, PipelineModel.load(f"{folder}/versions/{version}/model"), preparation, Calibrator(m["calibration"]["x"], m["calibration"]["y"]), m)
