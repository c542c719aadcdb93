"""Tables whose upserts touch few buckets, stages with restart, counters of a running job."""

import random

import pytest
from pyspark.sql import functions as F

from ringledger.operators import progress, stages
from ringledger.sources import bucketed, pointers
from ringledger.sources.bucketed import BucketedTable
from ringledger.sources.files import scratch


def rows(spark, data):
    return spark.createDataFrame(data, "k long, g string, x double")


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_delta_leaves_other_buckets(spark):
    data = [(i, "a" if i % 2 else None, float(i)) for i in range(200)]
    table = BucketedTable.create(rows(spark, data), scratch(spark), ["k", "g"], 16)
    assert content(table.read()) == content(rows(spark, data))
    before = table.manifest()["at"]
    delta = [(3, "a", -3.0), (4, None, -4.0), (1000, "n", 1.0)]
    touched = table.upsert(rows(spark, delta + [(1000, "n", 2.0)]), [F.desc("x")])
    after = table.manifest()["at"]
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    want = {(k, g): x for k, g, x in data} | {(k, g): x for k, g, x in delta} | {(1000, "n"): 2.0}
    assert content(table.read()) == sorted(((k, g, x) for (k, g), x in want.items()), key=str)
    assert content(table.read(version=1)) == content(rows(spark, data))
    assert table.upsert(rows(spark, [])) == [] and table.manifest()["version"] == 2


def test_a_failed_write_leaves_the_old_version(spark, monkeypatch):
    table = BucketedTable.create(rows(spark, [(i, "g", 0.0) for i in range(20)]), scratch(spark), ["k"], 4)
    real = pointers.replace
    monkeypatch.setattr(pointers, "replace", lambda s, p, t: (_ for _ in ()).throw(OSError()) if p.endswith("CURRENT") else real(s, p, t))
    with pytest.raises(OSError):
        table.upsert(rows(spark, [(1, "g", 9.0)]))
    monkeypatch.undo()
    bad = rows(spark, [(1, "g", 9.0)]).withColumn("x", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        table.upsert(bad)
    assert table.manifest()["version"] == 1 and table.read().filter("x <> 0").count() == 0
    table.upsert(rows(spark, [(1, "g", 9.0)]))
    assert content(table.read().filter("x <> 0")) == [(1, "g", 9.0)]


def test_two_writers_and_vacuum(spark, monkeypatch):
    table = BucketedTable.create(rows(spark, [(i, "g", 0.0) for i in range(20)]), scratch(spark), ["k"], 4)
    other = BucketedTable(spark, table.folder)
    real = bucketed.upsert

    def slow(*a):
        monkeypatch.setattr(bucketed, "upsert", real)
        other.upsert(rows(spark, [(2, "g", 5.0)]))
        return real(*a)

    monkeypatch.setattr(bucketed, "upsert", slow)
    with pytest.raises(bucketed.Outrun):
        table.upsert(rows(spark, [(1, "g", 9.0)]))
    assert content(table.read().filter("x <> 0")) == [(2, "g", 5.0)]
    before = content(table.read())
    assert table.vacuum(1) and content(table.read()) == before and table.vacuum(1) == []
    empty = BucketedTable.create(rows(spark, []), scratch(spark), ["k"], 4)
    assert empty.read().count() == 0 and len(empty.upsert(rows(spark, [(1, "g", 1.0)]))) == 1 and empty.read().count() == 1


def test_upserts_equal_a_dictionary(spark):
    r = random.Random(3)
    want = {}
    table = None
    for turn in range(4):
        data = {r.randrange(60): float(turn * 100 + i) for i in range(25)}
        want |= data
        df = rows(spark, [(k, "g", x) for k, x in data.items()])
        table = BucketedTable.create(df, scratch(spark), ["k"], 5) if table is None else (table.upsert(df), table)[1]
    assert content(table.read()) == sorted(((k, "g", x) for k, x in want.items()), key=str)


def test_stages_restart_where_they_failed(spark):
    home, ran, broken = scratch(spark), [], [True]

    def stage(name, priority, make, revision="1"):
        def run(tables):
            ran.append(name)
            if name == "c" and broken[0]:
                raise OSError
            return make(tables)

        return stages.Stage(name, priority, run, revision)

    plan = [stage("c", 30, lambda t: t["b"].agg(F.sum("x").alias("s"))), stage("a", 10, lambda t: t["src"].filter("k > 1")), stage("b", 20, lambda t: t["a"].withColumn("x", F.col("x") * 2)), stage("d", 40, lambda t: t["c"])]
    src = rows(spark, [(i, "g", float(i)) for i in range(5)])
    tables, log = stages.run(spark, home, plan, {"src": src})
    assert log == [(10, "a", "done"), (20, "b", "done"), (30, "c", "failed: OSError"), (40, "d", "not run")] and ran == ["a", "b", "c"]
    broken[0] = False
    tables, log = stages.run(spark, home, plan, {"src": src.repartition(3)})
    assert [x[2] for x in log] == ["kept", "kept", "done", "done"] and ran == ["a", "b", "c", "c", "d"]
    assert tables["d"].first()["s"] == 18.0
    _, log = stages.run(spark, home, plan, {"src": src})
    assert [x[2] for x in log] == ["kept"] * 4
    _, log = stages.run(spark, home, plan, {"src": src.unionByName(src.limit(1))})
    assert [x[2] for x in log] == ["done"] * 4
    changed = [*plan[:2], stage("b", 20, lambda t: t["a"], "2"), plan[3]]
    _, log = stages.run(spark, home, changed, {"src": src})
    assert [x[2] for x in log] == ["done"] * 4  # the manifest has the last input's tables only


def test_counters_of_a_batch(spark):
    df = rows(spark, [(i, "g", float(i)) for i in range(10)])
    seen_df, seen = progress.observed(df, "rows", n=F.count(F.lit(1)), high=F.count_if(F.col("x") >= 7))
    seen_df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10, "high": 3}


def test_counters_of_a_stream(spark):
    home = scratch(spark)
    for lo in (0, 10, 20):
        rows(spark, [(i, "g", float(i)) for i in range(lo, lo + 10)]).coalesce(1).write.mode("append").parquet(home)
    got = []
    listener = progress.Progress("seen", lambda batch, counters: got.append((batch, counters)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("k long, g string, x double").option("maxFilesPerTrigger", 1).parquet(home).observe("seen", F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
        stream.writeStream.format("noop").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(c["n"] for _, c in got) == 30 and sum(c["s"] for _, c in got) == sum(range(30)) and len(got) >= 3
