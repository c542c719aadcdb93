"""The pipeline beside a brute-force version on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline as P
from test_rowwise import brute_hits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(900)]
    line = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(8, 14))) + "."
    base = ["\n".join(line() for _ in range(8)) for _ in range(12)]
    bench = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(4)]
    docs = []
    for i in range(70):
        text = base[i] if i < 12 else "\n".join(line() for _ in range(r.randint(6, 12)))
        if 12 <= i < 30:
            words = base[i % 6].split(" ")
            for _ in range(r.choice([0, 1, 2])):
                words[r.randrange(len(words))] = "other"
            text = " ".join(words)
        elif 30 <= i < 36:
            text += "\n" + bench[i % 4][1] + "."
        elif 36 <= i < 42:
            text = text.replace(".", "")
        elif 42 <= i < 46:
            text = "too short."
        docs.append((i, text, "en", r.choice(["a", "b", None]), len(text)))
    docs += [(70, None, "en", "a", 0), (71, "", None, "b", 0), docs[0]]
    return docs, bench


def brute(docs, bench):
    from ringledger.llm.quality import line_fails, repeated_words

    kept = {}
    for i, t, _, s, _ in docs:
        words = WORD.findall(t or "")
        lines = (t or "").split("\n")
        bad = [x for x in lines if WORD.search(x) and line_fails(x, WORD.findall(x))]
        lost = sum(len(WORD.findall(x)) for x in bad)
        if len(words) >= 50 and 2 * repeated_words(words) <= len(words) and 2 * lost <= len(words):
            kept[i] = ("\n".join(x for x in lines if x not in bad), s)
    sets = {i: {tuple(w[j : j + 5]) for w in [WORD.findall(t.lower())] for j in range(len(w) - 4)} for i, (t, _) in kept.items()}
    up = {i: i for i in sets}
    top = lambda x: x if up[x] == x else top(up[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    kept = {i: v for i, v in kept.items() if top(i) == i}
    bad = {d for d, _, _, _, hit in brute_hits([(i, t) for i, (t, _) in kept.items()], bench, 13) if hit}
    return {i: v for i, v in kept.items() if i not in bad}


def test_pipeline(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    want = brute(docs, bench)
    assert {(r["doc_id"], r["text"]) for r in out} <= {(i, t) for i, (t, _) in want.items()}
    copies = Counter(r["doc_id"] for r in out)
    assert max(copies.values()) <= 2 and len(copies) > 20
    size = {i: len(WORD.findall(t)) for i, (t, _) in want.items()}
    for source in ("a", "b", None):  # whole copies overshoot a source's target by less than one text
        mine = [i for i, (_, s) in want.items() if s == source]
        assert sum(copies[i] * size[i] for i in mine) <= 2 * sum(size[i] for i in mine)
    total = sum(copies[i] * size[i] for i in copies)
    assert 1.5 * sum(size.values()) <= total <= 1.5 * sum(size.values()) + 3 * max(size.values())
    slots = Counter(r["shard"] for r in out)
    assert max(slots.values()) - min(slots.values()) <= 1 and len(P.STAGES) == 5
    for n in slots:
        assert sorted(r["slot"] for r in out if r["shard"] == n) == list(range(slots[n]))
