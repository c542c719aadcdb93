"""Bets and market studies on frames of contests with probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions import markets as MK


def value_bets(df: DataFrame, p: str = "p", decimal_a: str = "decimal_a", decimal_b: str = "decimal_b", least_edge: float = 0.03) -> DataFrame:
    """None to two rows a contest: the sides whose expected value is above the least edge."""
    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.col(p).alias("prob"), F.col(decimal_a).alias("decimal"), MK.expected_value(F.col(p), F.col(decimal_a)).alias("edge")),
        F.struct(F.lit("b").alias("side"), (1 - F.col(p)).alias("prob"), F.col(decimal_b).alias("decimal"), MK.expected_value(1 - F.col(p), F.col(decimal_b)).alias("edge")),
    )
    return df.withColumn("bet", F.explode(F.filter(sides, lambda x: x["edge"] > least_edge))).select(*df.columns, "bet.*")


def returns(bets: DataFrame, won: str = "won", decimal: str = "decimal", keys: Sequence[str] = ()) -> DataFrame:
    """n, win rate, profit and return on stakes of one unit."""
    profit = F.sum(MK.profit(F.col(won), F.col(decimal)))
    return bets.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(won).cast("int")).alias("rate"), profit.alias("profit"), (profit / F.count("*")).alias("roi"))


def by_strategy(df: DataFrame, strategies: dict[str, Callable[[], Column]], won_a: str = "won") -> DataFrame:
    """Returns of named strategies; a strategy is a function giving a nullable struct (side, decimal) for a row."""
    choices = F.array(*(F.struct(F.lit(name).alias("strategy"), choose().alias("bet")) for name, choose in strategies.items()))
    placed = df.withColumn("x", F.explode(choices)).filter("x.bet is not null")
    won = F.when(F.col("x.bet.side") == "a", F.col(won_a)).otherwise(~F.col(won_a))
    return returns(placed.select(F.col("x.strategy").alias("strategy"), F.col("x.bet.decimal").alias("decimal"), won.alias("won")), keys=["strategy"])


def bias_study(df: DataFrame, segment: Column, expected: str = "p", won: str = "won", least: int = 20) -> DataFrame:
    """Win rate against expectation in each segment of at least so many rows."""
    rows = df.groupBy(segment.alias("segment")).agg(F.count("*").alias("n"), F.avg(F.col(won).cast("int")).alias("rate"), F.avg(expected).alias("expected"))
    return rows.filter(F.col("n") >= least).withColumn("edge", F.col("rate") - F.col("expected"))
