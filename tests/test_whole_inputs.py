"""Whole tables go in; what is missing or bad is so by a real column, not by its id."""

import pytest

from compare import connect, differences
from ringledger.plans import registry

FOLDER = "/root/testdata/sf0.001"
WHOLE = {
    "dm56_multiple_tests": "WITH t AS (SELECT s_suppkey::VARCHAR AS name, (s_suppkey % 50) * (s_suppkey % 50) / 250000.0::DOUBLE AS p_value FROM supplier), r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value, name) - 1 AS i FROM t) SELECT name, p_value < 0.05::DOUBLE / n AS bonferroni, bool_and(p_value < 0.05::DOUBLE / (n - i)) OVER (ORDER BY p_value, name) AS holm FROM r",
    "st9_dictionary_merge": "SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(c_acctbal, s_acctbal) AS v FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    "snk13_append_bad_rows_skipped": "SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS number FROM customer WHERE TRY_CAST(substr(c_name, 10) AS BIGINT) IS NOT NULL",
    "jn16_two_tiers": "SELECT s_suppkey, CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN s_nationkey < 10 THEN coalesce((SELECT max(x.c_acctbal) FROM customer x WHERE x.c_nationkey = s_nationkey), 1500) ELSE 1500 END::DOUBLE AS rating FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey",
    "jn28_source_priority_merge": """SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 AND s_acctbal < 5000 THEN s_acctbal WHEN s_acctbal >= 0 THEN -1.0 END::DOUBLE AS balance,
CASE WHEN s_acctbal >= 0 AND s_nationkey > 5 THEN s_nationkey + 100 WHEN s_acctbal < 5000 THEN s_nationkey END AS nation,
CASE WHEN s_acctbal < 0 THEN 'primary' WHEN s_acctbal >= 5000 THEN 'secondary' ELSE 'both' END AS origin FROM supplier""",
}


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", WHOLE)
def test_whole_inputs(spark, name, folder):
    assert differences(spark, connect(folder), registry.queries()[name], WHOLE[name], folder) == ""


def test_bad_numbers_are_skipped(spark, tmp_path):
    rows = [(1, "Customer#000000007"), (2, "Customer#bad"), (3, None), (4, "Customer#000000008")]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["snk13_append_bad_rows_skipped"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (4, 8)]
