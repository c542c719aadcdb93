"""Every query beside its SQL on the smallest data, without those of the optional subpackage."""

import pytest

from compare import connect, differences
from ringledger.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: No such rows on so little data.
MAY_BE_EMPTY = {"jn27_blocked_fuzzy_match", "jn25_orphans", "jn20_exists", "dm66_constancy_check", "wn28_duplicate_groups", "src14_blocking_lookup", "jn26_pairs_in_group", "dm10_style_advantage", "dm18_differentials", "dm38_shares", "dm85_side_by_side"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, con, name):
    said = differences(spark, con, QUERIES[name], SQL[name], FOLDER)
    assert not said or said == "no rows" and name in MAY_BE_EMPTY, said


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n != "dm28_learners"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(QUERIES)
