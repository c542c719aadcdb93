"""Point-in-time features of an entity's history: what was known before each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.operators.contests import ordered

EVER = Window.unboundedPreceding


def before(n: int | None = None, skip: int = 0, entity: str = "entity") -> Window:
    """The n events before the current one (all of them without n), leaving out the last `skip`."""
    return ordered(entity).rowsBetween(EVER if n is None else -n - skip, -1 - skip)


def share(condition: Column, frame: Window) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0)).over(frame)


def streak(condition: Column, entity: str = "entity") -> Column:
    """How many of the events directly before fulfil the condition."""
    rank = F.row_number().over(ordered(entity))
    broken = F.last(F.when(~F.coalesce(condition, F.lit(False)), rank), ignorenulls=True)
    return rank - 1 - F.coalesce(broken.over(before(entity=entity)), F.lit(0))


def features(history: DataFrame, value: str = "value") -> DataFrame:
    """The feature row of every event, all over one sort of each entity's history."""
    won = F.col("result") == "win"
    finish = won & F.col("method").isin("KO", "SUB")
    x = F.col(value)
    change = x - F.lag(x).over(ordered())
    n_before = F.count("*").over(before())
    wins = F.sum(F.when(won, 1).otherwise(0)).over(before())
    finishes = F.sum(F.when(finish, 1).otherwise(0)).over(before())
    out = history.withColumn("change", change)
    mean3, mean5 = F.avg(x).over(before(3)), F.avg(x).over(before(5))
    career = F.when(F.coalesce(wins, F.lit(0)) > 0, finishes / wins).otherwise(0.0)
    last5 = share(finish, before(5))
    return out.select(
        "entity", "d", "id", "result", "method", value,
        mean3.alias("mean3"), mean5.alias("mean5"), F.max(x).over(before(5)).alias("max5"),
        F.sum("change").over(before(3)).alias("change_sum3"), F.avg("change").over(before(3)).alias("change_mean3"),
        share(finish, before(3)).alias("finish3"), last5.alias("finish5"), career.alias("finish_career"),
        (last5 - career).alias("finish_trend"),
        F.when(n_before >= 6, mean3 - F.avg(x).over(before(3, skip=3))).alias("value_trend"),
        (n_before > 0).alias("has_prior"),
        streak(won).cast("long").alias("win_streak"), streak(F.col("result") == "loss").cast("long").alias("loss_streak"),
    )


def point_in_time(history: DataFrame) -> DataFrame:
    """Cumulative totals before each event, one event an entity and day (later ones of a day are left out altogether)."""
    day = F.to_date("d")
    one = history.withColumn("_n", F.row_number().over(Window.partitionBy("entity", day).orderBy("d", "id"))).filter("_n = 1").drop("_n")
    won, lost = F.when(F.col("result") == "win", 1).otherwise(0), F.when(F.col("result") == "loss", 1).otherwise(0)
    n = F.count("*").over(before())
    return one.select(
        "entity", "d", "id", n.alias("n_before"),
        F.coalesce(F.sum(won).over(before()), F.lit(0)).alias("wins"), F.coalesce(F.sum(lost).over(before()), F.lit(0)).alias("losses"),
        F.when(n > 0, F.sum(won).over(before()) / n).otherwise(0.5).alias("win_rate"),
        F.coalesce(F.avg(won).over(before(3)), F.lit(0.5)).alias("recent3"), F.coalesce(F.sum("value").over(before()), F.lit(0.0)).alias("value_sum"),
    )


def recompute(history: DataFrame) -> DataFrame:
    """An independent version of a few features by self-join, to audit the window version for look-ahead."""
    prior = history.select(F.col("entity").alias("e"), F.struct("d", "id").alias("at"), F.col("value").alias("v"))
    now = history.select("entity", "id", F.struct("d", "id").alias("now"))
    pairs = now.join(prior, (F.col("entity") == F.col("e")) & (F.col("at") < F.col("now")), "left")
    last = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "v"))))), 1, 3)
    each = pairs.groupBy("entity", "id").agg(F.count("at").alias("n_before"), last.alias("last"))
    total = F.aggregate("last", F.lit(0.0), lambda s, r: s + r["v"])
    return each.select("entity", "id", "n_before", F.when(F.size("last") > 0, total / F.size("last")).alias("mean3"))
