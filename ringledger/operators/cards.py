"""A whole card of contests through the saved model: blended with the ratings, moved by penalties, with tiers; and value bets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.functions import markets as MK
from ringledger.functions import ratings as R
from ringledger.operators import metrics, production
from ringledger.sources.bundles import Bundle


def predicted(bundle: Bundle, features: DataFrame, contests: DataFrame, ratings: DataFrame, penalties: DataFrame | None = None, base: float = 1500.0) -> DataFrame:
    """id, d, a, b, model_p, rating_p, weighted (the model takes part), p, pick and tier for each contest.

    features: both orientations (production.replayed_features); ratings: entity, rating; penalties: entity, penalty (at most
    one row an entity). Missing features of the first orientation lower the model's weight. No features: ratings alone.
    """
    gaps = reduce(lambda x, y: x + y, (F.col(c).isNull().cast("int") for c in bundle.preparation.features))
    missing = features.filter(~F.col("swapped")).select(F.col("id").alias("_m"), gaps.alias("missing"))
    said = production.one_probability(bundle, features).select(F.col("id").alias("_i"), F.col("p").alias("model_p"), "symmetry")
    said = said.join(missing, F.col("_i") == F.col("_m")).drop("_m")
    slim = ratings.select("entity", "rating")
    slim = slim.join(penalties.select(F.col("entity").alias("_e"), "penalty"), F.col("entity") == F.col("_e"), "left").drop("_e") if penalties is not None else slim.withColumn("penalty", F.lit(None).cast("double"))
    rows = contests.select("id", "d", "a", "b")
    for side in "ab":
        rows = rows.join(slim.toDF(f"_{side}", f"r{side}", f"pen{side}"), F.col(side) == F.col(f"_{side}"), "left").drop(f"_{side}")
    rows = rows.join(said, F.col("id") == F.col("_i"), "left").drop("_i")
    rating_p = R.expected(F.coalesce("ra", F.lit(base)), F.coalesce("rb", F.lit(base)))
    weighted = F.coalesce((F.col("symmetry") <= 0.60) & (F.col("missing") <= 6), F.lit(False))
    blended = F.when(F.col("model_p").isNull(), MK.clamp(rating_p, 0.10, 0.90)).otherwise(MK.blend(F.col("model_p"), rating_p, F.col("symmetry"), F.col("missing")))
    zero = F.lit(0.0)
    p = MK.penalty_shifted(blended, F.coalesce("pena", zero), F.coalesce("penb", zero))
    rows = rows.withColumns({"rating_p": rating_p, "weighted": weighted, "p": p})
    sure = F.greatest(F.col("p"), 1 - F.col("p"))
    return rows.select("id", "d", "a", "b", "model_p", "rating_p", "weighted", "p", F.when(F.col("p") >= 0.5, F.col("a")).otherwise(F.col("b")).alias("pick"), metrics.tier(sure).alias("tier"))


def with_bets(card: DataFrame, odds: DataFrame, least: float = 0.05) -> DataFrame:
    """The card with bet_on, edge and stake (share of the bankroll). odds: id, decimal_a, decimal_b; none: no bet."""
    rows = card.join(odds.select(F.col("id").alias("_o"), "decimal_a", "decimal_b"), F.col("id") == F.col("_o"), "left").drop("_o")
    bet = MK.value_bet(F.col("p"), MK.implied(F.col("decimal_a")), MK.implied(F.col("decimal_b")), least)
    rows = rows.withColumns({"bet_on": bet["side"], "edge": bet["edge"]})
    stake = MK.kelly(F.col("edge"), F.when(F.col("bet_on") == "a", F.col("decimal_a")).otherwise(F.col("decimal_b")))
    return rows.withColumn("stake", F.when(F.col("bet_on").isNotNull(), stake))
