"""What the query modules share: a registry for queries with their SQL, and the adapters of both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.operators.contests import contests_of_lines, history_of_orders
from ringledger.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

HISTORY = """history AS (SELECT o_custkey AS entity, o_orderdate AS d, o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS result,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'KO' WHEN '2-HIGH' THEN 'SUB' ELSE 'DEC' END AS method,
  o_totalprice AS value FROM orders)"""
CONTEST = """revenue AS (SELECT l_orderkey, l_suppkey, sum(l_extendedprice) AS r FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS n FROM revenue),
contest AS (SELECT x.l_orderkey AS id, o_orderdate AS d, x.l_suppkey AS a, y.l_suppkey AS b,
  CASE WHEN x.r > y.r THEN x.l_suppkey ELSE y.l_suppkey END AS winner
  FROM ranked x JOIN ranked y ON x.l_orderkey = y.l_orderkey AND x.n = 1 AND y.n = 2 JOIN orders ON o_orderkey = x.l_orderkey)"""
LONG = CONTEST + """,
side AS (SELECT id, d, a AS entity, b AS opponent, winner = a AS won, false AS swapped FROM contest
  UNION ALL SELECT id, d, b, a, winner = b, true FROM contest WHERE a <> b)"""
PREDICTION = """prediction AS (SELECT o_orderkey AS id, o_orderdate AS d, o_custkey AS entity, 0.50 + (o_orderkey % 45) / 100.0::DOUBLE AS p,
  o_orderstatus = 'F' AS won, o_orderpriority AS kind FROM orders)"""
H = "WINDOW h AS (PARTITION BY entity ORDER BY d, id)"


def history(spark: SparkSession, folder: str) -> DataFrame:
    return history_of_orders(table(spark, folder, "orders"))


def contests(spark: SparkSession, folder: str) -> DataFrame:
    return contests_of_lines(table(spark, folder, "lineitem"), table(spark, folder, "orders"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    p = F.lit(0.5) + F.pmod("o_orderkey", F.lit(45)) / F.lit(100.0)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"), F.col("o_custkey").alias("entity"), p.alias("p"), (F.col("o_orderstatus") == "F").alias("won"), F.col("o_orderpriority").alias("kind"))


def r6(x: str | Column) -> Column:
    """Six decimals: sums of doubles depend on their order beyond that."""
    return F.round(x if isinstance(x, Column) else F.col(x), 6)


class Module:
    """Collects queries and their SQL."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[name] = f
            if sql is not None:
                self.SQL[name] = sql
            return f

        return add
