"""Pairs of a group and what tells their sides apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Members of a block, about, and how many tasks the meetings of blocks are dealt to at most.
BLOCK, TASKS = 1000, 5000


def pairs(profiles: DataFrame, key: str, group: str, block: int = BLOCK) -> DataFrame:
    """All unordered pairs of a group (the feature itself; groups are weight classes or the like).

    Groups are dealt into blocks by a hash of the key, and blocks meet pair by pair: a task makes some block x block
    pairs, whatever the size of the largest group. A row is copied once for each block of its group. The number of tasks
    is that of the meetings, since by the size of the rows Spark would put all groups into one. No key or group is null
    in a pair.
    """
    known = profiles.filter(F.col(key).isNotNull() & F.col(group).isNotNull())
    sizes = known.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    tasks = max(1, min(TASKS, sizes.agg(F.sum(F.col("_blocks") * F.col("_blocks"))).first()[0] or 0))
    dealt = known.join(sizes, F.col(group) == F.col("_g")).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")))
    names = profiles.columns
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))
    # (x, y) is the place where the blocks x and y meet: as side a a row goes along its line, as side b along its column
    zero = F.lit(0).cast("bigint")  # places of both sides are of one type, also in what may be null: else Spark shuffles again, into few tasks
    place = lambda x, y: F.struct(F.col("_g").alias("g"), F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y"))
    a = dealt.select("_g", "_block", each.alias("_other"), *(F.col(c).alias(f"a_{c}") for c in names)).withColumn("_a", place(F.col("_block"), F.col("_other")))
    b = dealt.select("_g", "_block", each.alias("_other"), *(F.col(c).alias(f"b_{c}") for c in names)).withColumn("_b", place(F.col("_other"), F.col("_block")))
    a, b = (side.drop("_g", "_block", "_other").repartition(tasks, at) for side, at in ((a, "_a"), (b, "_b")))
    return a.hint("shuffle_hash").join(b, (F.col("_a") == F.col("_b")) & (F.col(f"a_{key}") < F.col(f"b_{key}"))).drop("_a", "_b")


def differentials(paired: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """a minus b of each column; null if either side is missing."""
    return paired.withColumns({f"{c}_diff": F.round(F.col(f"a_{c}") - F.col(f"b_{c}"), digits) for c in columns})
