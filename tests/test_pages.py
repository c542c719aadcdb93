"""The tokenizer of pages on well-formed and broken ones, and exact binomial tests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ringledger.functions.pages import PLAIN, Page, fields, table_rows
from ringledger.operators import stats
from ringledger.plans import registry


def test_texts_of_elements():
    page = Page().finish("<title>A &amp; B</title><h1 class='x y'> One <b>two</b> three</h1><p class=y>four<br>five<script>no</script><div class=y></div></i><p class='x'>six")
    assert page.first("title", None) == "A & B" and page.first("h1", "x") == "One three" and page.first(None, "y") == "One three"
    assert page.first("p", "y") == "fourfive" and page.first("p", "x") == "six" and page.first("p", "z") is None
    assert Page().finish("").first(None, None) is None and Page().finish("<<<>><p").first("p", None) is None


def test_labels():
    page = Page().finish("<i class=l>Age</i><b class=v>30</b><b class=v>31</b><i class=l>Reach</i><i class=l>Town</i><b class=v>Oslo</b><i class=l>Age</i><b class=v>40</b>")
    assert page.labelled("l", "v") == {"age": "30", "town": "Oslo"}


def test_nested_tables():
    html = "<table><tr><td>a<td>b<tr><td>c<table><tr><th>x</th></tr><tr><td>y</table> d</td><td>e</tr></table><table><tr></tr><td>lone"
    assert Page().finish(html).rows == [(0, None, None, 0, ["a", "b"]), (0, None, None, 1, ["c d", "e"]), (1, 0, 1, 0, ["x"]), (1, 0, 1, 1, ["y"]), (2, None, None, 1, ["lone"])]


def test_frames(spark):
    df = spark.createDataFrame([(1, "<h1>n</h1><i class=l>Age</i><b class=v>3</b>"), (2, None), (3, "<title>t"), (4, "<table><tr><td>1")], "k long, html string")
    got = fields(df, "k", "html", {"name": (("h1", None), ("title", None))}, "l", "v", {"age": "Age"})
    assert sorted(map(tuple, got.collect())) == [(1, "n", "3"), (2, None, None), (3, "t", None), (4, None, None)]
    assert [tuple(r) for r in table_rows(df, "k", "html").collect()] == [(4, 0, None, None, 0, ["1"])]


def pmf(i, n, p):
    return math.comb(n, i) * p**i * (1 - p) ** (n - i)


@pytest.mark.parametrize("p", [0.0, 0.03, 0.5, 0.61, 1.0])
def test_binomial_tests_equal_sums(spark, p):
    cases = [(k, n) for n in (0, 1, 5, 12, 40) for k in range(-1, n + 2)]
    df = spark.createDataFrame([(k, n, p) for k, n in cases], "k int, n int, p double")
    rows = df.select("k", "n", stats.binomial_tail("k", "n", "p").alias("t"), stats.binomial_two_sided("k", "n", "p").alias("s")).collect()
    for k, n, t, s in rows:
        assert t == pytest.approx(sum(pmf(i, n, p) for i in range(max(0, k), n + 1)), abs=1e-10)
        if 0 <= k <= n:
            assert s == pytest.approx(min(1, sum(q for i in range(n + 1) if (q := pmf(i, n, p)) <= pmf(k, n, p) * (1 + 1e-7))), abs=1e-9)
        else:
            assert s is None


def test_large_numbers_take_few_terms(spark):
    df = spark.createDataFrame([(500_001_000, 1_000_000_000, 0.5)], "k long, n long, p double")
    got = df.select(stats.binomial_tail("k", "n", "p"), stats.binomial_two_sided("k", "n", "p")).first()
    z = 1000 / math.sqrt(2.5e8)
    assert got[0] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=1e-4) and got[1] == pytest.approx(2 * got[0], abs=1e-4)


def test_edge_verdicts(spark):
    df = spark.createDataFrame([(10, 0.9, 0.5, 1e-9), (200, 0.7, 0.5, 1e-9), (200, 0.51, 0.5, 0.4), (200, 0.54, 0.5, 1e-9)], "n int, r double, e double, p double")
    v = stats.edge_verdict(F.col("n"), F.col("r"), F.col("e"), F.col("p"))
    assert [(r[0], r[1], r[2]) for r in df.select(v["warnings"], v["valid"], v["usable"]).collect()] == [(["insufficient data"], False, False), ([], True, True), (["not significant", "too small"], False, True), ([], False, True)]


def slow(html):
    page = Page()
    page._plain = lambda x: (page.feed(x), page.close())
    return page.finish(html)


def test_plain_markup_is_read_as_the_parser_reads_it():
    r = random.Random(8)
    bits = ["<table>", "<table class=card>", "<TR>", "<td>", "</td>", "</tr>", "</table>", "<th>", "<b>", "</b>", "<br>", "<p class=\"a b\">", "</p>", "x", " y\n", "<div Class='q'>", "</div >", "&amp;", "<!-- c -->", "<script>1<2</script>", "<", ">", "<a href=x/>", "</p class=z>", "<title>a<b>", "<td class=\"\">"]
    plain = 0
    for i in range(6000):
        html = "".join(r.choices(bits[: 15 if i % 2 else None], k=r.randrange(25)))
        a, b = Page().finish(html), slow(html)
        plain += bool(PLAIN.fullmatch(html))
        assert (a.rows, a.closed) == (b.rows, b.closed), html
    assert plain > 2500


def test_card_pages_are_parsed_once(spark):
    card = registry.queries()["src17_src21_card_of_page"](spark, "/root/testdata/sf0.001")
    assert card._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
