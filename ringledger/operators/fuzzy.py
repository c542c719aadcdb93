"""Fuzzy names at scale: an index of deletion neighbourhoods, and lookup in tiers.

Two strings within k edits have a common string that each reaches by deleting k letters at most. So each distinct name
yields its variants with up to k letters deleted, as keys; names that share a key are candidates, and candidates are
confirmed by their edit distance. The number of keys depends on a name's length alone, and how many distinct names share
one on the length and the alphabet: no name is compared with all others, and no block of names with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variants(name: Column, edits: int) -> Column:
    """The distinct strings that remain of a name with 0 to `edits` letters deleted."""
    out = F.array(name)
    for _ in range(edits):
        fewer = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda s: F.length(s) > 0), fewer))))
    return out


def within(left: DataFrame, right: DataFrame, edits: int = 2, name: str = "name", block: Sequence[str] = ()) -> DataFrame:
    """left_name, right_name, distance and the block columns: pairs of distinct names of equal blocks, `edits` apart at most."""
    cut = lambda df: df.select(*block, name).filter(F.col(name).isNotNull()).distinct().select(*block, name, F.explode(variants(F.col(name), edits)).alias("_v"))
    a = cut(left).select(*block, F.col(name).alias("left_name"), F.xxhash64(*block, "_v").alias("_key"))
    b = cut(right).select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(block)), F.col(name).alias("right_name"), F.xxhash64(*block, "_v").alias("_other"))
    same = F.col("_key") == F.col("_other")
    for i, c in enumerate(block):
        same = same & (F.col(c) == F.col(f"_c{i}"))
    distance = F.levenshtein("left_name", "right_name")
    pairs = a.join(b, same).select(*block, "left_name", "right_name").distinct()
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= edits)


def first_and_last(name: Column) -> tuple[Column, Column]:
    """First letter of the first word (null for a single word) and the last word."""
    words = F.split(name, " ")
    return F.when(F.size(words) > 1, F.left(name, F.lit(1))), F.element_at(words, -1)


def tiered(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, name: str = "name", least_length: int = 5) -> DataFrame:
    """asked_id, tier, distance, known_id for each asked row: the best tier, then the fewest edits, then the smallest id; nulls if none fits.

    Names are plain (unicode.letters). Tiers: 1 the whole name; 2 last word and first initial; 3 last words of `least_length`
    letters or more within two edits, and the first initial; 4 the last word alone, where the asked name has no initial.
    """
    k = known.groupBy(name).agg(F.min(known_id).alias("_id")).filter(F.col(name) != "")
    initial, last = first_and_last(F.col(name))
    k = k.select(name, "_id", initial.alias("_i"), last.alias("_l"))
    a = asked.select(F.col(asked_id).alias("_a"), F.col(name).alias("_n"))
    initial, last = first_and_last(F.col("_n"))
    a = a.select("_a", "_n", initial.alias("_ai"), last.alias("_al"))
    # each tier's side of known names has one row a key, so that no join multiplies
    keyed = [
        k.select(F.lit(1).alias("tier"), F.col(name).alias("key"), "_id"),
        k.filter("_i is not null").groupBy(F.concat_ws(" ", "_i", "_l").alias("key")).agg(F.min("_id").alias("_id")).select(F.lit(2).alias("tier"), "key", "_id"),
        k.groupBy(F.col("_l").alias("key")).agg(F.min("_id").alias("_id")).select(F.lit(4).alias("tier"), "key", "_id"),
    ]
    keys = keyed[0].unionByName(keyed[1]).unionByName(keyed[2]).select(F.col("tier").alias("_t"), F.col("key").alias("_k"), "_id")
    asks = F.array(
        F.struct(F.lit(1).alias("tier"), F.col("_n").alias("key")),
        F.struct(F.lit(2).alias("tier"), F.when(F.col("_ai").isNotNull(), F.concat_ws(" ", "_ai", "_al")).alias("key")),
        F.struct(F.lit(4).alias("tier"), F.when(F.col("_ai").isNull(), F.col("_al")).alias("key")),
    )
    exact = a.select("_a", F.inline(asks)).join(keys, (F.col("tier") == F.col("_t")) & (F.col("key") == F.col("_k"))).select("_a", "tier", F.lit(0).alias("distance"), "_id")
    long = lambda c: F.length(c) >= least_length
    lasts = k.filter(F.col("_i").isNotNull() & long(F.col("_l"))).groupBy("_i", "_l").agg(F.min("_id").alias("_id"))
    wanted = a.filter(F.col("_ai").isNotNull() & long(F.col("_al")))
    # only known words of an asked length, two letters more or less, are cut: keys grow with the square of a word's length
    lengths = wanted.select(F.col("_ai").alias("_li"), F.explode(F.sequence(F.length("_al") - 2, F.length("_al") + 2)).alias("_ll")).distinct()
    lasts = lasts.join(lengths, (F.col("_i") == F.col("_li")) & (F.length("_l") == F.col("_ll")), "left_semi")
    near = within(wanted.select(F.col("_ai").alias("i"), F.col("_al").alias("name")), lasts.select(F.col("_i").alias("i"), F.col("_l").alias("name")), 2, block=["i"])
    near = near.join(lasts, (F.col("i") == F.col("_i")) & (F.col("right_name") == F.col("_l"))).groupBy("i", "left_name").agg(F.min(F.struct("distance", "_id")).alias("m"))
    loose = wanted.join(near, (F.col("_ai") == F.col("i")) & (F.col("_al") == F.col("left_name"))).select("_a", F.lit(3).alias("tier"), F.col("m.distance").alias("distance"), F.col("m._id").alias("_id"))
    best = exact.unionByName(loose).groupBy("_a").agg(F.min(F.struct("tier", "distance", "_id")).alias("m")).select(F.col("_a").alias("_b"), "m")
    return a.join(best, F.col("_a").eqNullSafe(F.col("_b")), "left").select(F.col("_a").alias(asked_id), F.col("m.tier").alias("tier"), F.col("m.distance").alias("distance"), F.col("m._id").alias(known_id))
