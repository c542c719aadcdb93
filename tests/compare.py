"""Runs each query beside its SQL in DuckDB: python tests/compare.py FOLDER [NAME...]."""

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return float(f"{float(x):.9g}")
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = got[1] - want[1], want[1] - got[1]
        return f"{sum(got[1].values())} and {sum(want[1].values())} rows; only Spark: {list(a)[:2]}; only SQL: {list(b)[:2]}"
    return "" if got[1] else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from ringledger.session import session

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con = session(4, "compare"), connect(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and not any(name.startswith(x) for x in only):
            continue
        began = time.time()
        try:
            said = differences(spark, con, query, sql[name], folder) if name in sql else f"rows only: {query(spark, folder).count()}"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(said) and not said.startswith("rows only")
        if said or time.time() - began > 8:
            print(name, round(time.time() - began, 1), said, flush=True)
    print("bad", bad)
    assert glob
