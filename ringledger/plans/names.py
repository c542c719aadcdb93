"""Queries of names and dirty text: Unicode folding, fuzzy names by an index, keyword places, exact rounding, injury checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringledger.functions import numbers
from ringledger.functions import ratings as R
from ringledger.functions import text as T
from ringledger.functions import unicode as U
from ringledger.operators import fuzzy
from ringledger.plans.base import Module
from ringledger.sources.tables import table

M = Module()
query = M.query


@query("fn1_fn2_unicode_folded", "SELECT doc_id, trim(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')), ' (jr|sr|ii|iii|iv)\\.?$', '')) AS name, lower(strip_accents(text)) AS folded FROM documents")
def fn1(spark, folder):
    """Whole texts without marks, by decomposition instead of a list of letters."""
    return table(spark, folder, "documents").select("doc_id", U.plain_name(F.col("text")).alias("name"), F.lower(U.unmarked("text")).alias("folded"))


NAME_SQL = "trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g'))"
TWO_SQL = "array_to_string(string_split({0}, ' ')[1:2], ' ')"


def first_words(column):
    """The first two words of a text as a name."""
    return U.leading(F.col(column), 2)


@query("fn6_jn27_tiered_names", f"""WITH k AS (SELECT name, min(doc_id) AS id FROM (SELECT doc_id, {TWO_SQL.format(NAME_SQL.format('text'))} AS name FROM documents) WHERE name <> '' GROUP BY 1),
a AS (SELECT item_id, {TWO_SQL.format(NAME_SQL.format("CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'i') ELSE split_part(text, ' ', 2) END"))} AS name FROM benchmark),
k2 AS (SELECT *, CASE WHEN contains(name, ' ') THEN left(name, 1) END AS i, string_split(name, ' ')[-1] AS l FROM k), a2 AS (SELECT *, CASE WHEN contains(name, ' ') THEN left(name, 1) END AS i, string_split(name, ' ')[-1] AS l FROM a),
p AS (SELECT item_id, k2.id, CASE WHEN a2.name = k2.name THEN 1 WHEN a2.i = k2.i AND a2.l = k2.l THEN 2 WHEN a2.i = k2.i AND length(a2.l) >= 5 AND length(k2.l) >= 5 AND levenshtein(a2.l, k2.l) <= 2 THEN 3 WHEN a2.i IS NULL AND a2.l = k2.l THEN 4 END AS tier, levenshtein(a2.l, k2.l)::INTEGER AS d FROM a2, k2),
b AS (SELECT item_id, min({{'tier': tier, 'distance': CASE WHEN tier = 3 THEN d ELSE 0 END, 'id': id}}) AS m FROM p WHERE tier IS NOT NULL GROUP BY 1)
SELECT a.item_id, m.tier AS tier, m.distance::INTEGER AS distance, m.id AS doc_id FROM a LEFT JOIN b ON a.item_id = b.item_id""")
def fn6(spark, folder):
    """Names asked in three spellings against all known ones: whole, last word with initial, two edits with initial, last word."""
    known = table(spark, folder, "documents").select("doc_id", first_words("text").alias("name"))
    turn = F.pmod("item_id", F.lit(3))
    spelt = F.when(turn == 0, F.col("text")).when(turn == 1, F.replace("text", F.lit("e"), F.lit("i"))).otherwise(F.split_part("text", F.lit(" "), F.lit(2)))
    asked = table(spark, folder, "benchmark").select("item_id", spelt.alias("t")).select("item_id", first_words("t").alias("name"))
    return fuzzy.tiered(asked, known, "item_id", "doc_id")


@query("jn27_fuzzy_index", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM documents WHERE lang = 'en')
SELECT w.word AS left_name, v.word AS right_name, levenshtein(w.word, v.word)::INTEGER AS distance FROM w JOIN v ON abs(length(w.word) - length(v.word)) <= 1 AND levenshtein(w.word, v.word) <= 1""")
def jn27(spark, folder):
    """Words of the items against all words of English documents, one edit apart at most: by deletion keys, not by all pairs."""
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("name")).distinct()
    return fuzzy.within(words(table(spark, folder, "benchmark")), words(table(spark, folder, "documents").filter("lang = 'en'")), 1)


MAJOR, MINOR = ("license", "email"), ("with", "avec")
_PLACE = "list_transform(regexp_extract_all(t, '.{{0,100}}{0}.{{0,100}}'), lambda c: {{'keyword': '{0}', 'severity': '{1}', 'context': trim(c)}})"


def _places(words, severity):
    return "list_concat(" + ", ".join(_PLACE.format(w, severity) for w in words) + ")"


@query("fn25_major_then_minor", f"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents), p AS (SELECT doc_id, {_places(MAJOR, 'major')} AS a, {_places(MINOR, 'minor')} AS b FROM d),
m AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a ELSE b END AS m FROM p) SELECT doc_id, len(m)::BIGINT AS n, m[1].keyword AS keyword, m[1].severity AS severity, m[1].context AS context FROM m WHERE len(m) > 0""")
def fn25(spark, folder):
    """Places of major words with a hundred characters on either side; of minor words only where there is no major one."""
    text = F.lower(T.squeezed(F.col("text")))
    found = table(spark, folder, "documents").select("doc_id", T.keyword_mentions(text, MAJOR, MINOR).alias("m")).filter(F.size("m") > 0)
    first = F.col("m")[0]
    return found.select("doc_id", F.size("m").cast("long").alias("n"), first["keyword"].alias("keyword"), first["severity"].alias("severity"), first["context"].alias("context"))


@query("fn34_python_round", """SELECT l_orderkey, l_linenumber, format('{:.2f}', l_quantity / 8)::DOUBLE AS eighths, format('{:.2f}', l_extendedprice * 0.005)::DOUBLE AS share, format('{:.1f}', l_discount * 2.5)::DOUBLE AS discount FROM lineitem""")
def fn34(spark, folder):
    """Half to even on the exact value of a double: eighths are true ties, the others only look like ties."""
    two = lambda x: numbers.python_round(x, 2)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", two(F.col("l_quantity") / 8).alias("eighths"), two(F.col("l_extendedprice") * 0.005).alias("share"), numbers.python_round(F.col("l_discount") * 2.5, 1).alias("discount"))


#: Words of the synthetic pages that stand for injuries; the last part of a host's first label stands for the name.
HURT, SORE = ("thouing", "reaon"), ("thered", "onand")


def injury_checks(profiles, news, as_of, major, minor, most_news: int = 5):
    """entity, mentions, keyword, severity, days, penalty: a profile's page and its first news pages as one text.

    profiles: entity, name, html; news: entity, position, html. No page is joined to more than one entity.
    """
    first = news.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy("position"))).filter(F.col("_n") <= most_news)
    texts = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("_n", T.visible_text(F.col("html")).alias("t")))).alias("ts")).select(F.col("entity").alias("_e"), F.array_join("ts.t", " ").alias("more"))
    whole = profiles.join(texts, F.col("entity") == F.col("_e"), "left").select("entity", "name", F.concat_ws(" ", T.visible_text(F.col("html")), "more").alias("text"))
    found = whole.select("entity", T.keyword_mentions(F.col("text"), major, minor, name=F.col("name")).alias("m"))
    one = F.try_element_at("m", F.lit(1))
    told = found.select("entity", F.size("m").alias("mentions"), one["keyword"].alias("keyword"), one["severity"].alias("severity"), F.datediff(as_of, T.injury_date(one["context"], as_of)).alias("days"))
    return told.withColumn("penalty", F.when(F.col("mentions") > 0, R.injury_penalty(F.col("severity"), F.col("days"))).otherwise(0))


_VISIBLE = "lower(trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


def _visible(html):
    for tag in ("script", "style", "nav", "footer", "header"):
        html = f"regexp_replace({html}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return _VISIBLE.format(html)


@query("dm74_injury_check", f"""WITH h AS (SELECT regexp_extract(url, '//([^/?#]+)', 1) AS entity, page_id, coalesce({_visible('html')}, '') AS t FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY page_id) AS n FROM h), w AS (SELECT entity, string_agg(t, ' ' ORDER BY n) AS t FROM r WHERE n <= 6 GROUP BY 1),
p AS (SELECT entity, {_places(HURT, 'major')} AS a, {_places(SORE, 'minor')} AS b FROM w), m AS (SELECT entity, CASE WHEN len(a) > 0 THEN a ELSE b END AS m FROM p)
SELECT entity, len(m)::INTEGER AS mentions, m[1].keyword AS keyword, m[1].severity AS severity, CASE m[1].severity WHEN 'major' THEN 55 WHEN 'minor' THEN 25 ELSE 0 END AS penalty FROM m""")
def dm74(spark, folder):
    """A host's first page as profile, its next five as news; nothing in them names a date, so half a year is taken."""
    host = F.regexp_extract("url", "//([^/?#]+)", 1)
    pages = table(spark, folder, "pages").select(host.alias("entity"), F.col("page_id").alias("position"), "html")
    placed = pages.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("position")))
    found = injury_checks(placed.filter("n = 1").select("entity", F.lit("").alias("name"), "html"), placed.filter("n > 1").drop("n"), F.lit("2020-01-01").cast("date"), HURT, SORE)
    return found.select("entity", "mentions", "keyword", "severity", "penalty")
