"""Learners on prepared features: fitted on `train`, calibrated on `val`, measured on `holdout`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.operators import ensemble, metrics
from ringledger.sources.files import stored


def learners(features: str = "features", label: str = "label") -> dict[str, object]:
    return {
        "logistic": LogisticRegression(featuresCol=features, labelCol=label, maxIter=20),
        "forest": RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=20, maxDepth=4, seed=42),
        "boosted": GBTClassifier(featuresCol=features, labelCol=label, maxIter=10, maxDepth=3, seed=42),
    }


def compare(df: DataFrame, columns: Sequence[str], label: str, part: str = "part") -> DataFrame:
    """One row a learner and the isotonic calibration of each: n, accuracy, brier, log_loss on the holdout."""
    ready = stored(df.select(*columns, part, F.col(label).cast("double").alias("label")))  # fitting reads it many times
    by = {x: ready.filter(F.col(part) == x) for x in ("train", "val", "holdout")}

    def measured(name: str, learner: object) -> list[DataFrame]:
        model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), learner]).fit(by["train"])
        ensemble.without_summary(model)
        scored = {x: model.transform(by[x]).withColumn("p", vector_to_array("probability")[1]) for x in ("val", "holdout")}
        isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="q").fit(scored["val"])
        calibrated = isotonic.transform(scored["holdout"]).withColumn("p", F.greatest(F.lit(0.10), F.least(F.lit(0.90), F.col("q"))))
        return [metrics.scores(rows.select("p", "label"), y="label").select(F.lit(kind).alias("learner"), "*") for kind, rows in ((name, scored["holdout"]), (f"{name}, calibrated", calibrated))]

    each = ensemble.side_by_side([lambda n=n, m=m: measured(n, m) for n, m in learners().items()])
    return ensemble.union([one for pair in each for one in pair])
