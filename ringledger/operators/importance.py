"""How much a fitted model leans on each feature: the trees' gains, and the loss when a column is permuted."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.sources.files import stored

#: Steps of the walk: each ends outside of 0 .. n - 1 with a chance under 2 / sqrt(n), and no small cycle is longer.
WALK = 64
#: Rows of a numbering bucket, about.
BUCKET = 5000


def numbered(rows: DataFrame, n: int, key: str, out: str) -> DataFrame:
    """Adds a number from 0 on, in the order of a hash of the key: buckets are counted, then rows within a bucket."""
    buckets = max(1, -(-n // BUCKET))
    h = rows.withColumns({"_h": F.xxhash64(key), "_b": F.pmod(F.xxhash64(key), F.lit(buckets))})
    above = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = h.groupBy(F.col("_b").alias("_c")).agg(F.count("*").alias("_k")).select("_c", F.coalesce(F.sum("_k").over(above), F.lit(0)).alias("_above"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return h.join(base, F.col("_b") == F.col("_c")).withColumn(out, F.col("_above") + inside).drop("_h", "_b", "_c", "_above")


def shuffled(number: Column, n: int, seed: int | Column, rounds: int = 6) -> Column:
    """A keyed permutation of 0 .. n - 1: a Feistel network on two digits, walked until the result lies within."""
    a = math.isqrt(max(0, n - 1)) + 1
    seed = F.lit(seed) if isinstance(seed, int) else seed

    def once(x: Column) -> Column:
        turn = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, seed), F.lit(a)), F.lit(a)).alias("r"))
        start = F.struct(F.floor(x / a).cast("long").alias("l"), F.pmod(x, F.lit(a)).cast("long").alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(rounds))), start, turn, lambda s: s["l"] * a + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def gains(model: PipelineModel, columns: Sequence[str]) -> dict[str, float]:
    """The built-in importance of a tree model's features; coefficients' sizes, scaled to sum to one, of a linear one."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(sum(values)) or 1.0
    return {c: float(v) / total for c, v in zip(columns, values, strict=True)}


def auc_by(rows: DataFrame, keys: Sequence[str], p: str, y: str, buckets: int = 1000, n: str | None = None) -> DataFrame:
    """Area under the ROC curve for each key: tied scores are merged, then counted from bucket to bucket of probability.

    With n, a row stands for so many, of which y have the outcome.
    """
    each = rows.groupBy(*keys, F.col(p).alias("_p")).agg((F.sum(n) if n else F.count("*")).alias("_n"), F.sum(F.col(y).cast("long")).alias("_pos"))
    each = each.withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor(F.col("_p") * buckets)))
    totals = each.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_c")).agg(F.sum("_n").alias("_all"))
    above = Window.partitionBy(*(f"_k_{k}" for k in keys)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_above", F.coalesce(F.sum("_all").over(above), F.lit(0)))  # `buckets` rows a key
    same = F.col("_bucket") == F.col("_c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.join(totals, same).withColumn("_rank", F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2)
    pos, neg = F.sum("_pos"), F.sum(F.col("_n") - F.col("_pos"))
    return ranked.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_rank") * F.col("_pos")) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def permuted(rows: DataFrame, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], key: str, label: str = "label", repeats: int = 10, seed: int = 42, merged: bool = False) -> DataFrame:
    """feature, auc (of the rows as they are), loss and spread: the mean fall of AUC over the repeats, and its deviation.

    predict adds p. Rows get numbers once; for each repeat, a row meets the row that the permutation sends it, by an equi-join,
    and yields a copy for each feature with that row's value. All copies are scored in one pass; with merged, equal ones are
    counted first, and each distinct row is scored once.
    """
    n = rows.count()
    slim = stored(numbered(rows.select(key, F.col(label).alias("_y"), *(F.col(c).cast("double").alias(c) for c in columns)), n, key, "_n"))
    turned = slim.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_to", shuffled(F.col("_n"), n, F.col("repeat") + seed))
    other = slim.select(F.col("_n").alias("_m"), F.struct(*columns).alias("_other"))
    met = turned.join(other, F.col("_to") == F.col("_m"))
    names = F.array(*map(F.lit, columns))
    copies = met.withColumn("feature", F.explode(names))
    copies = copies.select("feature", "repeat", F.col("_y"), *(F.when(F.col("feature") == c, F.col(f"_other.{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    plain = slim.select(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("repeat"), "_y", *columns)
    every = copies.unionByName(plain)
    if merged:
        each = stored(every.groupBy("feature", "repeat", *columns).agg(F.count("*").alias("_n"), F.sum(F.col("_y").cast("long")).alias("_pos")))
        said = stored(predict(each.select(*columns).distinct()).select(*columns, "p"))
        found = auc_by(each.join(said, list(columns)), ["feature", "repeat"], "p", "_pos", n="_n")
    else:
        found = auc_by(predict(every), ["feature", "repeat"], "p", "_y")
    found = stored(found)  # a row a feature and repeat
    whole = found.filter("feature is null").select(F.col("auc").alias("_whole"))
    fall = F.col("_whole") - F.col("auc")
    each = found.filter("feature is not null").join(F.broadcast(whole), F.lit(True)).groupBy("feature")
    return each.agg(F.first("_whole").alias("auc"), F.avg(fall).alias("loss"), F.stddev_pop(fall).alias("spread"))


def report(rows: DataFrame, columns: Sequence[str], model: PipelineModel, predict: Callable[[DataFrame], DataFrame], key: str, label: str = "label", **how: object) -> DataFrame:
    """The permutation importance of each feature beside its gain. A model that begins with bins sees no more of a row than them."""
    told = gains(model, columns)
    if isinstance(model.stages[0], Bucketizer):
        by, rest = model.stages[0], PipelineModel(model.stages[1:])
        bins = dict(zip(by.getInputCols(), by.getOutputCols(), strict=True))
        rows = by.transform(rows).select(key, label, *(F.col(bins[c]).alias(c) for c in columns))
        predict = lambda x: rest.transform(x.withColumns({b: F.col(c) for c, b in bins.items()})).select(*columns, vector_to_array("probability")[1].alias("p"))
        how["merged"] = True
    gain = F.create_map(*(x for c, v in told.items() for x in (F.lit(c), F.lit(v))))
    return permuted(rows, columns, predict, key, label, **how).withColumn("gain", F.try_element_at(gain, F.col("feature")))
