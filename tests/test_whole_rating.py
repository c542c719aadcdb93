"""The sequential rating of every player, by a loop."""

import duckdb

from ringledger.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_every_player_is_rated(spark):
    want, r, n = {}, {}, {}
    for u, won in duckdb.sql(f"SELECT user_id, event_type = 'purchase' FROM '{FOLDER}/events.parquet' ORDER BY ts, event_id").fetchall():
        old = r.get(u, 1500.0)
        r[u], n[u] = old + 32 * (won - 1 / (1 + 10 ** ((1500 - old) / 400))), n.get(u, 0) + 1
        want[u, n[u]] = r[u]
    rows = registry.queries()["dm3_rating_small_recursive"](spark, FOLDER).collect()
    got = {(x["user_id"], x["n"]): x["rating"] for x in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(n) > 1
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
