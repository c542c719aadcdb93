"""Which event an asked one means: by id, then by its whole name, then by the words that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.functions import unicode as U

# Words that tell events apart no better than none.
STOP = ("the", "and", "vs")


def words(title: Column) -> Column:
    """Distinct plain words of two characters or more."""
    each = F.split(F.trim(F.regexp_replace(F.lower(U.unmarked(title)), r"[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(each, lambda w: (F.length(w) > 1) & ~w.isin(*STOP)))


def weight(word: Column) -> Column:
    """Words of four letters or more say more."""
    return F.when(F.length(word) >= 4, 3).otherwise(1)


def events(asked: DataFrame, known: DataFrame, key: str, least: int = 4) -> DataFrame:
    """key, tier, score, event_id for each asked row; nulls if nothing fits.

    asked: key, event_id (may be null), title; known: event_id, title. Tiers: 1 the id; 2 the words of the title, in any order;
    3 the highest score of shared words, from `least` on; of equal ones the smallest id. Titles meet by their words, known
    titles with the same words are one row before they do.
    """
    k = known.select("event_id", F.array_sort(words(F.col("title"))).alias("ws"))
    distinct = k.filter(F.size("ws") > 0).groupBy("ws").agg(F.min("event_id").alias("_id"))
    a = asked.select(F.col(key).alias("_k"), F.col("event_id").alias("_asked"), F.array_sort(words(F.col("title"))).alias("_ws"))
    by_id = a.join(known.select(F.col("event_id").alias("_id")).distinct(), F.col("_asked") == F.col("_id")).select("_k", F.lit(1).alias("tier"), F.lit(0).alias("score"), "_id")
    whole = a.join(distinct.withColumnRenamed("_id", "_whole"), F.col("_ws") == F.col("ws")).select("_k", F.lit(2).alias("tier"), F.lit(0).alias("score"), F.col("_whole").alias("_id"))
    index = distinct.select("_id", F.explode("ws").alias("_w"))
    shared = a.select("_k", F.explode("_ws").alias("_v")).join(index, F.col("_v") == F.col("_w")).groupBy("_k", "_id").agg(F.sum(weight(F.col("_v"))).cast("int").alias("score"))
    loose = shared.filter(F.col("score") >= least).select("_k", F.lit(3).alias("tier"), "score", "_id")
    best = by_id.unionByName(whole).unionByName(loose).groupBy("_k").agg(F.min(F.struct("tier", (-F.col("score")).alias("minus"), "_id")).alias("m")).select(F.col("_k").alias("_b"), "m")
    return a.join(best, F.col("_k") == F.col("_b"), "left").select(F.col("_k").alias(key), F.col("m.tier").alias("tier"), (-F.col("m.minus")).alias("score"), F.col("m._id").alias("event_id"))

