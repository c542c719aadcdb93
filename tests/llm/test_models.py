import base64
import hashlib
import io
import math
import zipfile
import zlib
from collections import Counter
from pathlib import Path

import pytest

from corpus import frame, rows
from ringledger.llm import lm, warc


def fold(t):
    return ((t or "").encode().translate(lm.LOWER)).split()


def test_scores(spark):
    data = rows(n=120)
    train, held = Counter(), {}
    for i, t in data:
        held[i] = zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        if not held[i]:
            train.update([*fold(t), None])
    n, v = sum(train.values()), len(train)
    pieces = lm.Pieces(Path(lm.VOCABULARY).read_bytes())
    counts = Counter()
    for w, c in train.items():
        if w is not None:
            for x in pieces.cutter.encode(w.decode()):
                counts[x] += c
    scores, end = lm.piece_scores(pieces.size, counts, train[None])
    lattice = lm.Lattice(pieces, scores)
    want = {}
    for i, t in data:
        tokens = [*fold(t), None]
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        want[i, len(tokens)] = (held[i], sum(train[x] > 0 for x in tokens), n, pytest.approx(base), pytest.approx(end + sum(lattice.one(x.decode()) for x in tokens[:-1])))
    for mb in (6.0, 0.002):
        got = lm.score(frame(spark, data), bundle_mb=mb).collect()
        assert len(got) == len(data)
        for r in got:
            assert (r[1], *r[3:]) == want[r[0], r[2]], r[0]
    assert lm.score(frame(spark).limit(0)).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = lm.Pieces(Path(lm.VOCABULARY).read_bytes())
    scores, _ = lm.piece_scores(pieces.size, {i: i % 97 + 1 for i in range(pieces.size)}, 10)
    lattice = lm.Lattice(pieces, scores)
    words = ["the", "tion", "a", "éa", "x௧y", "\U0001f600", "internation"] * 3

    def brute(text):
        if not text:
            return 1.0
        total = 0.0
        for j in range(1, len(text) + 1):
            if text[:j] in lattice.score:
                total += 10 ** lattice.score[text[:j]] * brute(text[j:])
        if text[0] not in lattice.score:
            total += 10 ** lattice.fallback(text[0]) * brute(text[1:])
        return total

    many = lattice.many(words * 6)
    for w, s in zip(words * 6, many):
        assert s == pytest.approx(lattice.one(w)) and s == pytest.approx(math.log10(brute(lm.MARK + w)))
    assert math.isfinite(lattice.one("q" * 3000))


def page_rows():
    out = [(i, f"http://h/{i} ü\n", f"<p>{i % 7}</p>" * (i % 3)) for i in range(1, 60)]
    return out + [(100, None, None), (101, "u", ""), (5, "again", "<p>5</p>" * 2), (None, "n", "<p>2</p>" * 2), (None, "n", "alone"), (102, "big", "x" * 300_000), (103, "big", "x" * 300_000)]


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, tmp_path, least):
    data = page_rows()
    pages = spark.createDataFrame([(*x, 1) for x in data], "page_id long, url string, html string, size int").repartition(3)
    manifest = warc.write(pages, f"file://{tmp_path}/w", revisit_from=least, package_mb=0.0005)
    got = warc.read(manifest).collect()
    raw = [(h or "").encode() for _, _, h in data]
    first = {}
    for (i, _, _), p in zip(data, raw):
        if i is not None:
            first[p] = min(i, first.get(p, i))
    want = Counter()
    for (i, u, _), p in zip(data, raw):
        again = len(p) >= least and p in first and first[p] != i
        want[i, u, "revisit" if again else "response", first[p] if again else None, None if again else p, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()] += 1
    assert Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r[:7]) for r in got) == want
    names = [x["path"] for x in manifest.collect()]
    assert len(names) > 5
    with zipfile.ZipFile(warc.local_path(names[0])) as z:  # others can read the packages too
        assert z.testzip() is None and {warc.WARC, warc.INDEX} <= set(z.namelist())
        assert zlib.decompress(z.read(warc.WARC), 31).startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.write(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_zip64_directories(tmp_path):
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), str(i))
        z.writestr("packed", "y" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    with warc.Ranges(str(many)) as source:
        found = warc.directory(source)
        assert len(found) == 66_000 and "packed" not in found
        header, size = found["m65999"]
        assert source.read(warc.member_start(source, header), size) == b"65999"
    with open(tmp_path / "no.zip", "wb") as f:
        f.write(b"x" * 100)
    with pytest.raises(ValueError), warc.Ranges(str(tmp_path / "no.zip")) as source:
        warc.directory(source)
    assert io.BytesIO
