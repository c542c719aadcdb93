"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringledger.llm import centroids, decontam, lines, lm, mixing, neardup, oracles, quality, search, sharding, simhash, substrings, suffixes, warc
from ringledger.llm.common import load


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages")
    records = warc.read(warc.write(pages, warc.package_folder(pages), revisit_from=0), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.assign(load(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    rows = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.try_element_at("copies.position", F.lit(1)).alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substrings.remove_repeated(load(spark, folder, "documents"), window=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontam.find(load(spark, folder, "documents"), load(spark, folder, "benchmark"), window=13)
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated")


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffixes.remove_seen(load(spark, folder, "documents"), length=50)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(load(spark, folder, "documents"), vocabulary=lm.VOCABULARY)


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = sharding.shard(slim, shards=24, text_col="text_crc32")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.rules(load(spark, folder, "documents"), with_text=False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(load(spark, folder, "documents"), width=4, threshold=80)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines.dedup(load(spark, folder, "documents"), width=5, threshold=80)
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(load(spark, folder, "documents"), load(spark, folder, "benchmark"), top=10)


def op12_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    rows = centroids.cluster(load(spark, folder, "embeddings"), k=40, rounds=5, size=64, scale=256, seed="2")
    return centroids.centroid_names(rows).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(load(spark, folder, "documents"), radius=2, width=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

SQL: dict[str, str] = {
    "op1_warc": oracles.OP1,
    "op3_substring_dedup": oracles.OP3,
    "op4_decontamination": oracles.OP4,
    "op8_quality_rules": oracles.op8(quality.CLOSED, quality.NOISY_WORD, quality.MENU_WORD, quality.NOTICE, quality.FEW_WORDS),
    "op9_minhash_near_dedup": oracles.OP9,
    "op11_ranked_search": oracles.OP11,
    "op12_centroid_clustering": oracles.op12(k=40, rounds=5, seed="2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
