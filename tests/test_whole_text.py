"""Texts are cleaned to their end."""

import pytest

from compare import connect, differences
from ringledger.functions import text as T
from ringledger.plans import registry

FOLDER = "/root/testdata/sf0.001"
MARKS = f"translate(lower(x), '{T.MARKED}', '{T.PLAIN}')"
WHOLE = {
    "fn1_plain_name": f"SELECT doc_id, trim(regexp_replace(trim(regexp_replace({MARKS}, '\\s+', ' ', 'g')), ' (jr|sr|ii|iii|iv)\\.?$', '')) AS name FROM (SELECT doc_id, text || ' Jr.' AS x FROM documents)",
    "fn17_clean_text": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, TRY_CAST(regexp_extract(text, '(\\d+)', 1) AS INT) AS number FROM documents",
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_text(spark, name):
    assert differences(spark, connect(FOLDER), registry.queries()[name], WHOLE[name], FOLDER) == ""
