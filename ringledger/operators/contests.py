"""Contests and histories: the two shapes that every analytic operator works on.

A history has one row for each entity and event: entity, d, id, result (win, loss, draw), method, value.
A contest has two sides and a winner: id, d, a, b, winner; its long form has a row for each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringledger.operators.keyed import first_per_key


def history_of_orders(orders: DataFrame) -> DataFrame:
    """Orders read as a customer's history."""
    result = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("draw")
    method = F.when(F.col("o_orderpriority") == "1-URGENT", "KO").when(F.col("o_orderpriority") == "2-HIGH", "SUB").otherwise("DEC")
    return orders.select(
        F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("id"),
        result.alias("result"), method.alias("method"), F.col("o_totalprice").alias("value"),
    )


def contests_of_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The two suppliers with the lowest keys of an order meet; the one with more revenue wins (a tie is won by b)."""
    revenue = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_extendedprice").alias("revenue"))
    side = F.struct(F.col("l_suppkey").alias("k"), F.col("revenue").alias("r"))
    pairs = revenue.groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(side)), 1, 2).alias("s")).filter(F.size("s") == 2)
    a, b = F.col("s")[0], F.col("s")[1]
    made = pairs.select(F.col("l_orderkey").alias("id"), a["k"].alias("a"), b["k"].alias("b"), F.when(a["r"] > b["r"], a["k"]).otherwise(b["k"]).alias("winner"))
    return made.join(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d")), "id").select("id", "d", "a", "b", "winner")


def long_form(contests: DataFrame) -> DataFrame:
    """One row for each side: entity, opponent, won; a contest of an entity with itself gives one row."""
    both = F.when(F.col("a") == F.col("b"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    side = contests.withColumn("swapped", F.explode(both))
    me, other = F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a")), F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b"))
    return side.select("id", "d", me.alias("entity"), other.alias("opponent"), (F.col("winner") == me).alias("won"), "swapped")


def canonical(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """An unordered pair's key."""
    return F.least(a, b), F.greatest(a, b)


def first_of_pair(contests: DataFrame) -> DataFrame:
    """The first contest of each unordered pair and day."""
    lo, hi = canonical("a", "b")
    keyed = contests.withColumns({"lo": lo, "hi": hi, "day": F.to_date("d")})
    return first_per_key(keyed, ["lo", "hi", "day"], ["d", "id"]).drop("lo", "hi", "day")


def collapse_sides(sides: DataFrame, p: str = "p") -> DataFrame:
    """Back from two rows a contest to one: the mean of the first side's probabilities, the outcome of the unswapped row."""
    mine = F.when(F.col("swapped"), 1 - F.col(p)).otherwise(F.col(p))
    return sides.groupBy("id").agg(F.avg(mine).alias("p"), F.max(F.when(~F.col("swapped"), F.col("won"))).alias("won"))


def ordered(entity: str = "entity", order: tuple[str, ...] = ("d", "id")) -> Window:
    """The order of an entity's history; ties of time are broken by id."""
    return Window.partitionBy(entity).orderBy(*order)
