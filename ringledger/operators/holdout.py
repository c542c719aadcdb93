"""Evaluation of predictions on contests that no model has seen: measures, calibration bins and flat-odds returns, each with a bootstrap interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringledger.sources.files import stored

# Fixed values of the evaluation: bins of the first side's probability, the least probability of a bet (break-even and edge), flat odds.
BINS = ((0.50, 0.55), (0.55, 0.60), (0.60, 0.65), (0.65, 0.70), (0.70, 1.00))
BET, DECIMAL = 0.524 + 0.05, 1.91
#: Measures that are a sum over contests, divided by how many count.
SUMS = ("accuracy", "row_accuracy", "brier", "log_loss", "roi", *(f"gap, {a:.2f} to {b:.2f}" for a, b in BINS))
#: Distinct probabilities of a range, and of those that draw together.
RANGE, CHUNK = 20_000, 1000


def _parts(p: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """What a contest with outcome y adds to the sums (row_accuracy aside) and to their counts: a row a measure, a column a probability."""
    q, one = np.clip(p, 1e-15, 1 - 1e-15), np.ones_like(p)
    first, second = p >= BET, 1 - p >= BET
    bet = first | second
    roi = np.where(bet, np.where(first == (y == 1), DECIMAL - 1, -1.0), 0.0)
    inside = [(p >= a) & (p < b) for a, b in BINS]
    sums = [((p > 0.5) == (y == 1)) * one, 0 * one, (p - y) ** 2, -np.log(q if y else 1 - q), roi, *(i * (y - p) for i in inside)]
    return np.array(sums), np.array([one, one, one, one, bet * one, *(i * one for i in inside)])


def _range(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The sums of a range of rising probabilities for each replicate, number 0 being the contests as they are."""
    at, pos, neg, above = None, *np.zeros((3, replicates + 1))
    sums, counts = np.zeros((2, len(SUMS), replicates + 1))
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            some = batch.slice(k, CHUNK)
            p, n = some.column("p").to_numpy(), np.stack([some.column(f"n{i}").to_numpy() for i in range(6)])  # lost and won by 0, 1, 2 rows right
            w = np.zeros((6, len(p), replicates + 1))
            w[:, :, 0] = n
            for j, name in enumerate(p.view(np.uint64).tolist()):
                there = np.flatnonzero(n[:, j])
                w[there, j, 1:] = np.random.default_rng([seed, name]).poisson(n[there, j][:, None], (len(there), replicates))
            lost, won = w[:3].sum(0), w[3:].sum(0)
            under = np.cumsum(lost, 0) - lost + neg
            above += (won * (under + lost / 2)).sum(0)
            for y, x in ((0, lost), (1, won)):
                f, d = _parts(p, y)
                sums += f @ x
                counts += d @ x
            sums[SUMS.index("row_accuracy")] += ((w[1] + w[4]) / 2 + w[2] + w[5]).sum(0)
            pos, neg, at = pos + won.sum(0), neg + lost.sum(0), p[0] if at is None else at
    if at is not None:
        names = ["at", "replicate", "pos", "neg", "above", *(f"s{i}" for i in range(len(SUMS))), *(f"d{i}" for i in range(len(SUMS)))]
        yield pa.record_batch([pa.array(x) for x in (np.full(replicates + 1, at), np.arange(replicates + 1), pos, neg, above, *sums, *counts)], names=names)


def intervals(contests: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """measure, n (contests that count), value, lo and hi (95 %) from p, won and right (how many of a contest's two rows are right alone).

    All measures come from the same replicates. Contests with one probability and outcome draw together: a Poisson number of
    their count, which is the sum of their single draws. Ranges of probabilities are summed in their own tasks; for the area under the ROC
    curve, a range adds the pairs within it and those with the lost contests of all ranges below it.
    """
    n = [F.count_if((F.col("won") == y) & (F.col("right") == r)).alias(f"n{3 * y + r}") for y in (0, 1) for r in (0, 1, 2)]
    each = stored(contests.withColumn("won", F.col("won").cast("int")).groupBy(F.col("p").cast("double").alias("p")).agg(*n))
    schema = "at double, replicate long, pos double, neg double, above double, " + ", ".join(f"{x}{i} double" for x in "sd" for i in range(len(SUMS)))
    ranges = max(1, -(-each.count() // RANGE))
    parts = stored(each.repartitionByRange(ranges, "p").sortWithinPartitions("p").mapInArrow(lambda b: _range(b, replicates, seed), schema))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("replicate").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = F.try_divide(F.sum(F.col("above") + F.col("pos") * F.col("_below")), F.sum("pos") * F.sum("neg"))
    found = [F.struct(F.lit("auc").alias("measure"), F.sum(F.col("pos") + F.col("neg")).alias("n"), area.alias("value"))]
    found += [F.struct(F.lit(m).alias("measure"), F.sum(f"d{i}").alias("n"), F.try_divide(F.sum(f"s{i}"), F.sum(f"d{i}")).alias("value")) for i, m in enumerate(SUMS)]
    rows = parts.withColumn("_below", below).groupBy("replicate").agg(F.array(*found).alias("m")).select("replicate", F.inline("m"))
    drawn = lambda x: F.when(F.col("replicate") > 0, F.col(x))
    real = lambda x: F.max(F.when(F.col("replicate") == 0, F.col(x)))
    return rows.groupBy("measure").agg(real("n").cast("long").alias("n"), real("value").alias("value"), F.percentile(drawn("value"), F.lit(0.025)).alias("lo"), F.percentile(drawn("value"), F.lit(0.975)).alias("hi"))
