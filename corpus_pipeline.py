"""A corpus pipeline of five stages over the table documents: clean, deduplicate, decontaminate, mix, shard.

STAGES lists (name, function); a function takes (spark, docs, folder) and returns a DataFrame, which is written as
parquet into shared storage and read again as the next one's docs. Each stage works on all rows that the one before
kept. Defined cases are those of the operators: quality, neardup, decontam, mixing and sharding in ringledger/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringledger.llm import decontam, mixing, neardup, quality, sharding
from ringledger.llm.common import load, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail the base rule or lose more than half of their words."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, 80 %)."""
    return neardup.drop_near_duplicates(docs, width=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows cover a twentieth or more go."""
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"), window=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row."""
    return sharding.shard(docs, shards=24)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]

#: MinHash, Wu-Manber search and hash-ordered mixing aren't expressible in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
