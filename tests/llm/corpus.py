"""A small corpus with every defined case: nulls, blanks, copies, near copies, long words, ties, periodic text."""

import random


def rows(seed=7, n=60):
    r = random.Random(seed)
    words = ["alpha", "be", "ça", "Delta", "e", "øre", "gamma", "x1", "THE", "of", "and", "to", "in", "42"]
    long = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = long(70)
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "a " * 150), (5, "z" * 3000), (6, passage)]
    for i in range(7, n):
        kind = i % 6
        text = long(r.randint(1, 120))
        if kind == 1:
            text = long(r.randint(0, 9)) + "\n" + passage + "\n" + long(r.randint(0, 9))
        elif kind == 2:
            text = out[r.randrange(3, len(out))][1]
        elif kind == 3:
            t = (out[r.randrange(6, len(out))][1] or "").split(" ")
            for _ in range(2):
                t[r.randrange(len(t))] = "CHANGED"
            text = " ".join(t)
        elif kind == 4:
            p = passage.split(" ")
            a = r.randrange(30)
            text = "  ".join(p[a : a + r.randint(30, 45)]) + "\v\f" + long(3)
        out.append((i, text))
    out += [(n, out[6][1]), (n, out[6][1]), (None, passage), (None, "only here " + long(60))]
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, b int, g int").repartition(3)


def words_of(text):
    return (text or "").encode().split()
