"""Events by id, whole title and shared words against plain Python."""

import re

from ringledger.operators import resolution


def plain(title):
    return {w for w in re.split(r"[^a-z0-9]+", (title or "").lower()) if len(w) > 1 and w not in ("the", "and", "vs")}


def test_tiers(spark):
    known = [(10, "Night 12: Silva vs. Jones"), (11, "Night 13: Silva vs. Brown"), (12, "Jones versus Silva, night 12"), (13, "SILVA vs Jones night 12"), (14, ""), (15, None), (16, "The And")]
    asked = [(1, 11, "Night 12: Silva vs. Jones"), (2, None, "jones - SILVA - 12 night"), (3, None, "Brown Silva"), (4, None, "12"), (5, 99, "night"), (6, None, None), (7, None, "Silva"), (8, 99, "Jones Silva")]
    k = spark.createDataFrame(known, "event_id long, title string")
    a = spark.createDataFrame(asked, "q long, event_id long, title string")
    want = {}
    for q, i, title in asked:
        options = [(1, 0, i)] if i in {e for e, _ in known} else []
        ws = plain(title)
        for e, t in known:
            ks = plain(t)
            if ks and ks == ws:
                options.append((2, 0, e))
            score = sum(3 if len(w) >= 4 else 1 for w in ws & ks)
            if score >= 4:
                options.append((3, -score, e))
        best = min(options, default=None)
        want[q] = (best[0], -best[1], best[2]) if best else (None, None, None)
    got = {r["q"]: (r["tier"], r["score"], r["event_id"]) for r in resolution.events(a, k, "q").collect()}
    assert got == want and {t for t, *_ in want.values()} == {1, 2, 3, None}
