"""One function for each command of the engine; all take and give DataFrames, none prints, none needs a server.

Contests: id, d, a, b, winner. Histories: entity, d, id, result, method, value. Predictions: id, d, p, won and labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.functions import markets as MK
from ringledger.functions import ratings as R
from ringledger.functions import text as T
from ringledger.functions import unicode
from ringledger.operators import contests as C
from ringledger.operators import history as H
from ringledger.operators import cards, ensemble, fuzzy, keyed, learners, markets, matchups, metrics, production, rating, rules, splits, stages, stats
from ringledger.operators.isotonic import Calibrator
from ringledger.sources import bundles
from ringledger.sources.bucketed import BucketedTable
from ringledger.sources.files import stored


def rate(contests: DataFrame, component: str | None = None, enhanced: bool = False) -> DataFrame:
    """Rating history of both sides of every contest; enhanced ratings take form and shifts into account."""
    return rating.rate(contests, component, enhanced)


def historical_features(history: DataFrame) -> DataFrame:
    """Point-in-time feature row of every event."""
    return H.features(history)


def audit(history: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """n and mismatches of window features against a recomputation from earlier rows only."""
    both = H.features(history).select("entity", "id", F.col("mean3").alias("x")).join(H.recompute(history).select("entity", "id", F.col("mean3").alias("y")), ["entity", "id"])
    off = (F.col("x").isNull() != F.col("y").isNull()) | (F.abs(F.col("x") - F.col("y")) > tolerance)
    return both.agg(F.count("*").alias("n"), F.count_if(F.coalesce(off, F.lit(False))).alias("mismatches"))


def point_in_time(history: DataFrame) -> DataFrame:
    """Cumulative totals before every event."""
    return H.point_in_time(history)


def differentials(profiles: DataFrame, key: str, group: str, columns: Sequence[str]) -> DataFrame:
    """All pairs of a group with their differences."""
    return matchups.differentials(matchups.pairs(profiles, key, group), columns)


def validate(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule."""
    return rules.violations(df, conditions)


def load(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert by key."""
    return keyed.upsert(base, delta, keys)


def train(features: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Fits all learners on the first 70 % in time, calibrates on the next 15 %, measures on the rest. Needs d and id."""
    return learners.compare(splits.by_position(features, ["d", "id"], [("train", 0.7), ("val", 0.85), ("holdout", 1.0)]), columns, label)


def match(sides: DataFrame) -> DataFrame:
    """Win probability, market odds and method split of pairs with columns a_rating, b_rating, a_/b_ power, threat, decision_rate."""
    p = MK.tempered(R.expected(F.col("a_rating"), F.col("b_rating")))
    a, b = MK.simulated_odds(F.col("a_rating") - F.col("b_rating"))
    split = lambda x: MK.method_split(F.col(f"{x}_power"), F.col(f"{x}_threat"), F.col(f"{x}_decision_rate"))
    return sides.withColumns({"p": p, "decimal_a": a, "decimal_b": b, "how_a": split("a"), "how_b": split("b")})


def adjust(profiles: DataFrame, days: str = "days", rating_col: str = "rating") -> DataFrame:
    """Adds penalty and adjusted rating for inactivity."""
    penalty = R.inactivity_penalty(F.col(days), F.col(rating_col))
    return profiles.withColumn("penalty", penalty).withColumn("adjusted", F.col(rating_col) - F.col("penalty"))


def resolve(log: DataFrame, contests: DataFrame) -> DataFrame:
    """Winner of the latest contest of each logged pair (a, b), or null."""
    lo, hi = C.canonical("a", "b")
    last = contests.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.max_by("winner", F.struct("d", "id")).alias("winner"))
    return log.withColumns({"lo": lo, "hi": hi}).join(last, ["lo", "hi"], "left").drop("lo", "hi")


def backtest(predictions: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Scores of the predictions of a half-open span of days."""
    span = predictions.filter((F.col("d") >= F.lit(start).cast("timestamp_ntz")) & (F.col("d") < F.lit(end).cast("timestamp_ntz")))
    return metrics.scores(span, y="won", keys=keys)


def summary(predictions: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Accuracy by tier, by band, by each label and over all, in one pass."""
    rows = predictions.withColumns({"tier": metrics.tier(F.col("p")), "band": metrics.band(F.col("p"))})
    return metrics.breakdown(rows, ["tier", "band", *labels])


def monthly(predictions: DataFrame) -> DataFrame:
    return metrics.scores(predictions.withColumn("month", F.date_format("d", "yyyy-MM")), y="won", keys=["month"])


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    return metrics.bins(predictions, bins, y="won")


def roi(predictions: DataFrame, thresholds: Sequence[float] = (0.55, 0.57, 0.60, 0.65, 0.70), decimal: float = 1.91) -> DataFrame:
    profit = MK.profit(F.col("won"), F.lit(decimal))
    return metrics.by_threshold(predictions, "p", thresholds, [F.count("*").alias("n"), (F.sum(profit) / F.count("*")).alias("roi")])


def weakness(predictions: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Groups of confident predictions with exact binomial tails against their mean probability, corrected for many tests."""
    sure = predictions.filter(F.col("p") >= threshold)
    each = sure.groupBy(F.concat_ws("|", *keys).alias("name")).agg(F.count("*").alias("n"), F.count_if(~F.col("won")).alias("misses"), F.avg(1 - F.col("p")).alias("rate"))
    return stats.corrected(each.withColumn("p_value", stats.binomial_tail("misses", "n", "rate")))


def bias_study(predictions: DataFrame, segment: Column) -> DataFrame:
    return markets.bias_study(predictions, segment)


def mentions(pages: DataFrame, words: Sequence[str], html: str = "html", key: str = "page_id", around: int = 100) -> DataFrame:
    """Keyword hits in the visible text of pages, with their surroundings."""
    text = T.visible_text(F.col(html))
    found = F.array(*(F.struct(F.lit(w).alias("word"), T.in_context(F.col("text"), w, around).alias("hits")) for w in words))
    return pages.select(key, text.alias("text")).select(key, F.inline(found)).select(key, "word", F.explode("hits").alias("context"))


def train_model(spark: SparkSession, home: str, contests: DataFrame, ratings: DataFrame) -> str:
    """Fits, calibrates and saves a model on point-in-time features of the contests; gives the version that the pointer now names.

    The first 70 % of the contests in time teach a forest, the next 15 % its calibration; the rest is left for evaluation.
    """
    parts = splits.by_position(contests.select("id", "d"), ["d", "id"], [("train", 0.7), ("val", 0.85), ("holdout", 1.0)]).select(F.col("id").alias("_i"), "part")
    rows = stored(production.training_features(contests, ratings).join(parts, F.col("id") == F.col("_i")).drop("_i"))
    train = stored(rows.filter("part = 'train'"))
    preparation = bundles.Preparation.of(train, production.FEATURES)
    model = ensemble.fitted(preparation.apply(train), production.FEATURES, ensemble.forest())
    calibrator = Calibrator.fit(ensemble.scored(preparation.apply(rows.filter("part = 'val'")), model))
    later = production.one_probability(bundles.Bundle("new", model, preparation, calibrator), rows.filter("part = 'holdout'"))
    measures = metrics.scores(later, y="won").first().asDict()
    return bundles.save(spark, home, model, preparation, calibrator, metrics=measures)


def predict_card(spark: SparkSession, home: str, upcoming: DataFrame, history: DataFrame, ratings: DataFrame, penalties: DataFrame | None = None, odds: DataFrame | None = None) -> DataFrame:
    """Picks for contests to come by the saved model, profiles as of their day, ratings and penalties; with odds, bets and stakes."""
    bundle = bundles.load(spark, home, features=production.FEATURES)
    rows = upcoming if "winner" in upcoming.columns else upcoming.withColumn("winner", F.lit(None).cast("long"))
    card = cards.predicted(bundle, production.replayed_features(rows, history, ratings), rows, ratings, penalties)
    return cards.with_bets(card, odds) if odds is not None else card


def find_names(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, name: str = "name") -> DataFrame:
    """The known row that each asked name means, by tiers of spelling."""
    plain = lambda df, i: df.select(i, unicode.letters(F.col(name)).alias("name"))
    return fuzzy.tiered(plain(asked, asked_id), plain(known, known_id), asked_id, known_id)


def update_log(spark: SparkSession, folder: str, log: DataFrame, contests: DataFrame) -> list[int]:
    """Writes the winners that are known now into a stored prediction log (a bucketed table keyed by a, b and d); gives the buckets rewritten."""
    done = resolve(log.drop("winner"), contests).filter("winner is not null")
    return BucketedTable(spark, folder).upsert(done)


def styles(profiles: DataFrame, strikes: str = "strikes", takedowns: str = "takedowns", submissions: str = "submissions") -> DataFrame:
    """Profiles with their style."""
    return profiles.withColumn("style", R.style(F.col(strikes), F.col(takedowns), F.col(submissions)))


def weekly(spark: SparkSession, home: str, plan: Sequence[stages.Stage], sources: Mapping[str, DataFrame], skip: Sequence[str] = ()) -> DataFrame:
    """Runs the stages that aren't skipped, in order and from where the last run ended: priority, name, state."""
    _, log = stages.run(spark, home, [s for s in plan if s.name not in set(skip)], sources)
    return spark.createDataFrame(log, "priority int, name string, state string")


def edges(tests: DataFrame, expected: float = 0.5) -> DataFrame:
    """Segments (n, won, expected rate) with exact test and verdict of all safeguards: p_value, warnings, valid, usable."""
    out = tests.withColumn("p_value", stats.binomial_two_sided("won", "n", F.lit(expected)))
    v = stats.edge_verdict(F.col("n"), F.col("won") / F.col("n"), F.col("expected"), F.col("p_value"))
    return out.select("*", v["warnings"].alias("warnings"), v["valid"].alias("valid"), v["usable"].alias("usable"))
