"""A benchmark of more blocks than a worker holds, and a payload that a third of all pages share."""

from collections import Counter

import pytest

from corpus import frame, rows
from ringledger.llm import decontam, warc
from test_rowwise import bench, brute_hits


@pytest.mark.parametrize("resident", [1, 3])
def test_benchmark_in_passes(spark, monkeypatch, resident):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontam, "RESIDENT", resident)
    data = rows()
    items = [(i, " ".join((data[7 + i][1] or "").split()[:30])) for i in range(14)] + [(50, None), (51, "a")]
    got = decontam.find(frame(spark), bench(spark, items)).collect()
    assert Counter((g[0], g[1], g[2], tuple(g[4]), g[5]) for g in got) == Counter(brute_hits(data, items, 13))
    assert all(s["last"] <= t["first"] for g in got for s, t in zip(g["spans"], g["spans"][1:]))
    kept = decontam.drop_contaminated(frame(spark), bench(spark, items))
    assert kept.columns == frame(spark).columns and Counter(x["doc_id"] for x in kept.collect()) == Counter(g[0] for g in got if not g[5])


def test_common_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    data = [(i, f"http://h/{i}", "<p>same</p>" * 40 if i % 3 == 0 else f"<p>{i}</p>" if i % 5 else "<p>some</p>") for i in range(1, 4001)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = warc.read(warc.write(pages, f"file://{tmp_path}/w", package_mb=0.05)).collect()
    first = {}
    for i, _, h in data:
        first.setdefault(h, i)
    assert Counter((r["page_id"], r["refers_to"], r["record_type"], r["payload_bytes"]) for r in got) == Counter((i, first[h] if first[h] != i else None, "response" if first[h] == i else "revisit", len(h)) for i, _, h in data)
