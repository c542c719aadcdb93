"""Operator 7, sharding: a keyed permutation of global row numbers decides shard and slot.

Rows are numbered 0 to N - 1 in the order of a hash (numbering.py). A Feistel network permutes the numbers of the
square a * a, a = ceil(sqrt(N)), and cycle walking applies it again to what falls outside of 0 to N - 1. Row p of the
permutation goes to shard p mod S, slot p div S: counts are at most one apart and slots have no gaps. Anyone can
compute a row's shard from its number, N and the seed. DataFrame functions only.

Law: `rows`. Equal texts are dealt like any others, as counts at most one apart leave no room for keeping groups of
thousands of copies together. Defined cases: a null text has no bytes and CRC 0; repeated rows are rows of their own;
null ids are ids; columns named shard or slot are replaced, others are carried along; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringledger.llm.numbering import before, bucket_count, row_hash

#: Walks of at most so many steps. N <= 1024: no cycle has more numbers outside. Above: a step ends outside with a
#: chance under 2 / sqrt(N) + 1 / N < 1/15, so that 66 in a row have a chance below 1e-77.
STEPS = 66


def feistel(x: Column, a: int, seed: int, rounds: int) -> Column:
    """A permutation of 0 .. a * a - 1 (a Feistel network on two digits of base a)."""
    start = F.struct(F.floor(x / F.lit(a)).cast("long").alias("l"), F.pmod(x, F.lit(a)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + mixed, F.lit(a)).cast("long").alias("r"))

    keys = F.array(*(F.lit(i) for i in range(rounds)))
    return F.aggregate(keys, start, turn, lambda s: s["l"] * F.lit(a) + s["r"])


def permuted(number: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """Where number 0 .. n - 1 goes in the permutation."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    once = feistel(number, a, seed, rounds)
    if a * a == n:
        return once
    walk = F.sequence(F.lit(1), F.lit(STEPS))
    return F.aggregate(walk, once, lambda x, _: F.when(x < n, x).otherwise(feistel(x, a, seed, rounds)))


def shard(docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with shard (int) and slot (long)."""
    n = docs.count()
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    hashed = docs.select(F.struct(*keep).alias("row"), row_hash(F.col(id_col), F.col(text_col), seed).alias("h"), F.lit(1).cast("long").alias("one"))
    hashed = hashed.withColumn("bucket", F.pmod("h", F.lit(bucket_count(n))))
    rows = before(hashed, hashed.select("bucket", "one"), [], "one", ["h"], "number")
    rows = rows.withColumn("p", permuted(F.col("number"), n, seed))
    return rows.select("row.*", F.pmod("p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("p") / F.lit(shards)).cast("long").alias("slot"))
