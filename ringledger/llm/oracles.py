"""SQL twins (DuckDB) of those training-data queries that SQL can express on whole tables.

None for 2 and 7 (their order comes from a 64-bit hash that DuckDB lacks), 5 (bytes), 6 (lattices), 10 (MinHash lines), 13 (a hash that DuckDB lacks):
tests/llm holds brute-force versions.
"""

WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS hex FROM p),
b AS (SELECT *, CAST(unhex(hex) AS BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM s)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT)::INT, 1)), '') AS payload_digest,
 CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b"""

OP3 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS s FROM x),
d AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS n FROM d, range(35) r(j)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS n FROM w),
kept AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY e.n) AS t FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.n = g.n WHERE g.n IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

OP4 = r"""WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 13) AS k, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i, ws FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, ks.k, unnest(range(1, len(ws) - ks.k + 2)) AS i, ws FROM f, ks WHERE len(ws) >= ks.k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, item_id FROM dw JOIN win ON win.k = dw.k AND win.s = array_to_string(dw.ws[dw.i:dw.i + dw.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(13) r(j) WHERE j < k GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT f.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM f LEFT JOIN words ON f.doc_id = words.doc_id LEFT JOIN items ON f.doc_id = items.doc_id"""


def op8(closed: str, noisy: str, menu: str, notice: str, few: int) -> str:
    q = lambda x: x.replace("'", "''")
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM t),
m AS (SELECT *, regexp_extract_all(line, {WORD}) AS ws FROM l),
v AS (SELECT doc_id, n, line, len(ws) AS k, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS dup,
  regexp_matches(lower(line), '{q(notice)}') OR (len(ws) >= {few} AND (NOT regexp_matches(line, '{q(closed)}')
   OR CASE WHEN regexp_matches(line, '[|»›>•·]') THEN 10 * len(list_filter(ws, lambda w: regexp_matches(w, '{q(menu)}'))) >= 3 * len(ws) ELSE false END
   OR 10 * len(regexp_extract_all(line, '[^\x20\x09-\x0D]*(?:{q(noisy)})[^\x20\x09-\x0D]*')) > 3 * len(ws))) AS fails FROM m WHERE len(ws) > 0),
a AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(k) FILTER (fails), 0) AS lost FROM v GROUP BY 1),
w AS (SELECT doc_id, regexp_extract_all(text, {WORD}) AS ws, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(3) x(j) GROUP BY 1),
o AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN a ON w.doc_id = a.doc_id LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words AS kept FROM o"""


OP9 = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i, ws FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 3], ' ')) AS h FROM x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS low FROM w UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b),
c AS (SELECT node, min(low) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN c ON c.node = w.doc_id"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t),
x AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS c FROM p JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, sum(c)::BIGINT AS score FROM q JOIN x USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""


def op12(k: int, rounds: int, seed: str) -> str:
    """Long form: a row for each component, and a chain of an assignment and new centroids for each round."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, unnest(range(64)) AS i, floor(256 * unnest(e)::DOUBLE)::BIGINT AS x FROM v),
h AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k}),
c0 AS (SELECT c, i, x AS m FROM h JOIN x USING (r))"""
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            # the floor of a mean, also below zero
            parts.append(f"s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS k FROM a{n} JOIN x USING (r) GROUP BY c, i)")
            parts.append(f"c{n + 1} AS (SELECT c, i, coalesce((s - ((s % k) + k) % k) // k, m) AS m FROM c{n} LEFT JOIN s{n} USING (c, i))")
    parts.append(f"names AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS name FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, name AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN names USING (c)"""
