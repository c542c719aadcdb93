"""Bundles of rows: rows without an id spread over all of them."""

from pyspark.sql import functions as F

from ringledger.llm import lines, substrings
from ringledger.llm.common import bundle_of


def unnamed(spark, n):
    texts = F.concat_ws(" ", F.lit("some words"), F.col("id"), F.col("id") * 7, F.lit("x\nand a line of"), F.col("id"))
    return spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), texts.alias("text"))


def test_a_third_of_rows_without_id_spreads(spark):
    sizes = [r["count"] for r in unnamed(spark, 30000).groupBy(bundle_of(["doc_id", "text"], 50)).count().collect()]
    assert len(sizes) == 50 and max(sizes) < 2 * min(sizes)


def test_rows_without_id_keep_their_results(spark):
    docs = unnamed(spark, 300)
    one = {r["text"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup(docs, width=5).collect()}
    many = {r["text"]: (r["n_lines"], r["n_removed"]) for r in lines.dedup(docs, width=5, bundle_mb=0.001).collect()}
    assert one == many and len(one) > 250
    got = substrings.remove_repeated(docs.unionByName(docs.filter("doc_id is null")), window=6, k=3, bundle_mb=0.001)
    assert got.filter("doc_id is null and n_removed < n_words").count() == 0
