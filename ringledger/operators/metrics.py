"""Measures of predictions: accuracy, calibration, ranking quality, returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.operators import ranks


def scores(df: DataFrame, p: str = "p", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, Brier score and log-loss."""
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    truth = F.col(y).cast("int")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when((F.col(p) >= 0.5) == (truth == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(F.pow(F.col(p) - truth, 2)).alias("brier"), F.avg(-(truth * F.ln(q) + (1 - truth) * F.ln(1 - q))).alias("log_loss"),
    )


def auc(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks of ties.

    Ties are counted per distinct score first; distinct scores are ranked by buckets.
    """
    each = df.groupBy(p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    ranked = ranks.with_below(each, p).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"))
    return sums.select(F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc"))


def bins(df: DataFrame, n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Reliability bins of equal width that aren't empty."""
    b = F.least(F.lit(n_bins - 1), F.floor(F.col(p) * n_bins)).cast("int")
    each = df.groupBy(b.alias("bin")).agg(F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("actual"), F.count("*").alias("n"))
    return each.withColumn("error", F.abs(F.col("predicted") - F.col("actual")))


def calibration_error(df: DataFrame, n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Mean distance of predicted and actual rates, weighted by bin size, and a verdict."""
    e = F.sum(F.col("error") * F.col("n")) / F.sum("n")
    return bins(df, n_bins, p, y).agg(e.alias("ece")).withColumn("verdict", F.when(F.col("ece") > 0.10, "poor").when(F.col("ece") > 0.05, "moderate").otherwise("good"))


def by_threshold(df: DataFrame, column: str, thresholds: Sequence[float], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of the rows at or above each threshold: every row is repeated for the thresholds it reaches, no join."""
    reached = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(column) >= t)
    return df.withColumn("threshold", F.explode(reached)).groupBy("threshold").agg(*aggregates)


def tier(p: Column) -> Column:
    """Confidence tiers."""
    return F.when(p >= 0.70, "high").when(p >= 0.60, "medium").when(p >= 0.55, "low").otherwise("toss-up")


def band(p: Column) -> Column:
    """Probabilities in steps of five hundredths, .50 to .95."""
    return F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.bround(p * 20, 0) / 20))


def breakdown(df: DataFrame, keys: Sequence[str], won: str = "won") -> DataFrame:
    """n, correct and accuracy over each key by itself and over all, in one pass (grouping sets)."""
    total = [F.count("*").alias("n"), F.sum(F.col(won).cast("int")).alias("correct")]
    sets = df.groupingSets([[F.col(k)] for k in keys] + [[]], *keys).agg(*total, *(F.grouping(k).alias(f"_{k}") for k in keys))
    kind = F.lit("all")
    value = F.lit(None).cast("string")
    for k in keys:
        kind = F.when(F.col(f"_{k}") == 0, k).otherwise(kind)
        value = F.when(F.col(f"_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return sets.select(kind.alias("kind"), value.alias("value"), "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"))


def missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of every column, in one pass: name, missing, percent."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("missing")) for c in columns))
    return one.select("_n", F.inline(pairs)).select("name", "missing", F.try_divide(100.0 * F.col("missing"), F.col("_n")).alias("percent"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass: a, b, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))))


def winsor_bounds(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: <column>_lo and <column>_hi, exact interpolated percentiles."""
    return ranks.percentiles(df, {f"{c}_{n}": (c, q) for c in columns for n, q in (("lo", low), ("hi", high))})


def prepare(train: DataFrame, apply_to: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Clips by the training rows' bounds, fills by their medians, and scales by their mean and population deviation.

    What the training rows give is one row, read back before it is used; nothing of `apply_to` enters it.
    """
    bounds = winsor_bounds(train, columns).first()
    clip = lambda c: F.greatest(F.lit(bounds[f"{c}_lo"]), F.least(F.lit(bounds[f"{c}_hi"]), F.col(c)))
    clipped = train.select(*(F.when(F.col(c).isNotNull(), clip(c)).alias(c) for c in columns))
    medians = ranks.percentiles(clipped, {c: (c, 0.5) for c in columns}).fillna(0.0).first()
    filled = clipped.select(*(F.coalesce(c, F.lit(medians[c])).alias(c) for c in columns))
    moments = filled.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = {}
    for c in columns:
        x = F.coalesce(F.when(F.col(c).isNotNull(), clip(c)), F.lit(medians[c]))
        scaled[c] = (x - F.lit(moments[f"{c}_m"])) / F.lit(moments[f"{c}_s"] or 1.0)
    return apply_to.withColumns(scaled)
