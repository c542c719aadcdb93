import random

from ringledger.llm import lines, queries


def test_query_finds_lines_with_one_edit(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 7)))
    pairs = []
    while len(pairs) < 60:
        base = " ".join(word() for _ in range(14))[: 30 + len(pairs) % 51].strip()
        k = r.randrange(len(base))
        edited = [base[:k] + "#" + base[k + 1 :], word()[:4] + " " + base, base + " " + word()[:4]][len(pairs) % 3]
        p, q = lines.shingles(base, 5), lines.shingles(edited, 5)
        if 30 <= min(len(base), len(edited)) and max(len(base), len(edited)) <= 80 and 100 * len(p & q) >= 80 * len(p | q):
            pairs.append((base, edited))
    apart = [" ".join(word() for _ in range(10)) for _ in range(60)]
    data = [(i, f"{base}\n{apart[i]}") for i, (base, _) in enumerate(pairs)] + [(100 + i, edited) for i, (_, edited) in enumerate(pairs)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"]) for x in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (2, 0) for i in range(60)} | {100 + i: (1, 1) for i in range(60)}
