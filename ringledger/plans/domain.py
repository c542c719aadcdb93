"""Domain operators as queries (DM): ratings, penalties, styles, quality, markets, safeguards, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringledger.functions import markets as MK
from ringledger.functions import numbers
from ringledger.functions import ratings as R
from ringledger.operators import asof, keyed, markets, matchups, metrics, ranks, rating, rules, splits, stats
from ringledger.operators import history as H
from ringledger.operators.contests import long_form
from ringledger.plans.base import CONTEST, HISTORY, LONG, PREDICTION, Module, contests, history, predictions, r6
from ringledger.sources.files import stored
from ringledger.sources.tables import table

M = Module()
query = M.query
RATED = CONTEST + """, rated AS (SELECT c.*, 1500 + x.s_acctbal / 20 AS ra, 1500 + y.s_acctbal / 20 AS rb, x.s_nationkey AS na, y.s_nationkey AS nb, winner = a AS won
  FROM contest c JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey), q AS (SELECT *, 1 / (1 + pow(10, (rb - ra) / 400)) AS p FROM rated)"""


def rated(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", (1500 + F.col("s_acctbal") / 20).alias("r"), "s_nationkey")
    out = contests(spark, folder).join(s.toDF("a", "ra", "na"), "a").join(s.toDF("b", "rb", "nb"), "b").withColumn("won", F.col("winner") == F.col("a"))
    return out.withColumn("p", R.expected(F.col("ra"), F.col("rb")))


def profiles(spark, folder):
    """Suppliers as profiles: balance as rating, key-derived strikes, takedowns, submissions."""
    k = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("balance"), (k % 60 / 10.0).alias("strikes"), (k % 35 / 10.0).alias("takedowns"), (k % 15 / 10.0).alias("submissions"))


PROFILE = "profile AS (SELECT s_suppkey AS k, s_nationkey AS g, s_acctbal AS balance, (s_suppkey % 60) / 10.0::DOUBLE AS strikes, (s_suppkey % 35) / 10.0::DOUBLE AS takedowns, (s_suppkey % 15) / 10.0::DOUBLE AS submissions FROM supplier)"
STYLE = "CASE WHEN takedowns > 2.5 THEN 'wrestler' WHEN submissions > 1.0 THEN 'grappler' WHEN strikes > 4.0 AND takedowns < 2.0 THEN 'striker' ELSE 'balanced' END"


@query("dm1_k_factor", "SELECT o_orderkey, round(32 * CASE o_orderkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.25 ELSE 1 END * CASE left(o_orderpriority, 1) WHEN '1' THEN 1.3 WHEN '2' THEN 1.25 ELSE 1 END * CASE o_orderkey % 6 WHEN 1 THEN 1.2 WHEN 2 THEN 1.1 WHEN 3 THEN 1.05 WHEN 4 THEN 1.02 ELSE 1 END, 6)::DOUBLE AS k FROM orders")
def dm1(spark, folder):
    i, p = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    kind = F.when(i % 3 == 0, "title").when(i % 3 == 1, "main").otherwise("regular")
    how = F.when(p == "1", "KO/TKO").when(p == "2", "Submission").otherwise("Decision - Unanimous")
    return table(spark, folder, "orders").select("o_orderkey", r6(R.k_factor(kind, how, (i % 6).cast("int"))).alias("k"))


@query("dm2_mean_reversion", "SELECT c_custkey, round(CASE WHEN c_custkey % 900 / 365 > 0.5 THEN r - (r - 1500) * 0.1 * (c_custkey % 900 / 365) ELSE r END, 6) AS r FROM (SELECT c_custkey, 1500 + c_acctbal / 20 AS r FROM customer)")
def dm2(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", r6(R.reverted(1500 + F.col("c_acctbal") / 20, F.col("c_custkey") % 900)).alias("r"))


@query("dm3_sequential_rating")
def dm3(spark, folder):
    return rating.rate(contests(spark, folder)).select("id", "entity", r6("before").alias("before"), r6("after").alias("after"), r6("expected").alias("expected"), "result")


@query("dm3_rating_invariant", "WITH " + CONTEST + " SELECT count(*) AS contests, 0::BIGINT AS unbalanced FROM contest")
def dm3b(spark, folder):
    """What one side wins the other loses, in every contest."""
    each = rating.rate(contests(spark, folder)).groupBy("id").agg(F.abs(F.sum("change")).alias("x"))
    return each.agg(F.count("*").alias("contests"), F.count_if(F.col("x") > 1e-9).alias("unbalanced"))


@query("dm3_rating_small_recursive", """WITH RECURSIVE e AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, user_id AS u, event_type = 'purchase' AS won FROM events),
step(u, n, r) AS (SELECT DISTINCT u, 0::BIGINT, 1500.0::DOUBLE FROM e UNION ALL SELECT e.u, e.n, r + 32 * (won::INT - 1 / (1 + pow(10, (1500 - r) / 400))) FROM step JOIN e ON e.u = step.u AND e.n = step.n + 1)
SELECT u AS user_id, n, round(r, 6) AS rating FROM step WHERE n > 0""")
def dm3c(spark, folder):
    """Every player against a fixed opponent: the sequential kernel, a linear pass over each player's events."""

    def path(rows):
        rows, r, out = rows.sort_values(["ts", "event_id"]), 1500.0, []
        for won in rows["won"]:
            r += 32 * (won - 1 / (1 + 10 ** ((1500 - r) / 400)))
            out.append(r)
        return rows[["user_id"]].assign(n=range(1, len(rows) + 1), rating=out)

    e = table(spark, folder, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").cast("int").alias("won"))
    return e.groupBy("user_id").applyInPandas(path, "user_id long, n long, rating double").select("user_id", "n", r6("rating").alias("rating"))


@query("dm4_enhanced_expectation", "WITH " + RATED + " SELECT id, round(greatest(0.05, least(0.95, p + 0.5 * ((na - nb) / 100.0::DOUBLE + (ra - rb) * 0.0005))), 6) AS e FROM q")
def dm4(spark, folder):
    shift = 0.5 * ((F.col("na") - F.col("nb")) / 100.0 + (F.col("ra") - F.col("rb")) * 0.0005)
    return rated(spark, folder).select("id", r6(MK.clamp(F.col("p") + shift, 0.05, 0.95)).alias("e"))


@query("dm5_enhanced_rating")
def dm5(spark, folder):
    """Sequential ratings whose expectation is moved by age, reach and form (tests/test_ratings.py has the loop)."""
    k = F.col("s_suppkey")
    s = table(spark, folder, "supplier").select(k.alias("k"), (20.0 + k % 25).alias("age"), (62.0 + k % 19).alias("reach"))
    rows = contests(spark, folder).join(s.toDF("a", "age_a", "reach_a"), "a").join(s.toDF("b", "age_b", "reach_b"), "b")
    none = F.lit(0.0)
    shifted = rows.withColumns({"shift_a": R.enhanced_shift(F.col("age_a"), F.col("reach_a"), F.col("reach_b"), none), "shift_b": R.enhanced_shift(F.col("age_b"), F.col("reach_b"), F.col("reach_a"), none)})
    return rating.rate(shifted, enhanced=True).select("id", "entity", r6("after").alias("after"), r6("expected").alias("expected"), "result")


@query("dm6_ratings_peaks_and_unrated")
def dm6(spark, folder):
    """Peaks of the rated; the others get an estimate from their record."""
    peaks = rating.peaks(rating.rate(contests(spark, folder)))
    others = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity")).join(peaks, "entity", "left_anti")
    record = history(spark, folder).groupBy("entity").agg(*(F.count_if(F.col("result") == x).alias(x) for x in ("win", "loss", "draw")))
    none = F.lit(None).cast("double")
    guess = R.prior_estimate(F.col("win"), F.col("loss"), F.col("draw"), none, none, none, none)["rating"]
    rest = others.join(record, "entity").select("entity", r6(guess).alias("rating"), r6(guess).alias("peak"), F.lit(0).cast("long").alias("n"))
    return peaks.select("entity", r6("rating").alias("rating"), r6("peak").alias("peak"), "n").unionByName(rest)


PRIOR = """SELECT entity, w, l, d, w + l + d AS n, 20 + entity % 25 AS age, (entity % 1500)::DOUBLE AS days, f FROM (SELECT entity, count(*) FILTER (result = 'win') AS w, count(*) FILTER (result = 'loss') AS l, count(*) FILTER (result = 'draw') AS d,
 count(*) FILTER (result = 'win' AND method <> 'DEC') / nullif(count(*) FILTER (result = 'win'), 0) AS f FROM history GROUP BY 1)"""


@query("dm7_prior_estimate", "WITH " + HISTORY + ", r AS (" + PRIOR + """), s AS (SELECT *, 15 * ln(w + 1) - 20 * ln(l + 1) + 3 * ln(d + 1) AS record, w / n AS rate, n / greatest(1, age - 21) AS fpy FROM r)
SELECT entity, round(1500 + greatest(-180, least(220, record + CASE WHEN rate >= 0.95 THEN 60 WHEN rate >= 0.90 THEN 45 WHEN rate >= 0.85 THEN 35 WHEN rate >= 0.80 THEN 25 WHEN rate >= 0.75 THEN 15 WHEN rate >= 0.70 THEN 8 ELSE 0 END
+ CASE WHEN fpy >= 4 THEN 10 WHEN fpy >= 2.5 THEN 5 WHEN fpy >= 1.5 THEN 0 WHEN fpy >= 0.5 THEN -10 ELSE -20 END + CASE WHEN coalesce(f, 0) >= 0.8 THEN 20 WHEN f >= 0.6 THEN 10 WHEN f >= 0.4 THEN 5 ELSE 0 END
+ CASE WHEN days <= 365 THEN 15 WHEN days <= 730 THEN 5 WHEN days >= 1095 THEN -15 ELSE 0 END + CASE WHEN age BETWEEN 25 AND 32 THEN 10 WHEN age > 38 THEN -15 WHEN age > 35 THEN -5 WHEN age < 23 THEN 5 ELSE 0 END)), 4) AS rating, round(record, 4) AS record FROM s""")
def dm7(spark, folder):
    win = F.col("result") == "win"
    rec = history(spark, folder).groupBy("entity").agg(F.count_if(win).alias("w"), F.count_if(F.col("result") == "loss").alias("l"), F.count_if(F.col("result") == "draw").alias("d"), F.try_divide(F.count_if(win & (F.col("method") != "DEC")).cast("double"), F.count_if(win)).alias("f"))
    age, days = 20 + F.col("entity") % 25, (F.col("entity") % 1500).cast("double")
    e = R.prior_estimate(F.col("w"), F.col("l"), F.col("d"), age, days, F.lit(None).cast("double"), F.col("f"))
    return rec.select("entity", F.round(e["rating"], 4).alias("rating"), F.round(e["record"], 4).alias("record"))


@query("dm9_style", "WITH " + PROFILE + f" SELECT k, {STYLE} AS style FROM profile")
def dm9(spark, folder):
    return profiles(spark, folder).select("k", R.style(F.col("strikes"), F.col("takedowns"), F.col("submissions")).alias("style"))


@query("dm10_style_advantage", "WITH " + PROFILE + f", s AS (SELECT k, g, {STYLE} AS style FROM profile) SELECT x.k AS a, y.k AS b, CASE WHEN (x.style, y.style) IN (('wrestler', 'striker'), ('grappler', 'wrestler'), ('striker', 'grappler')) THEN 1 WHEN (y.style, x.style) IN (('wrestler', 'striker'), ('grappler', 'wrestler'), ('striker', 'grappler')) THEN -1 ELSE 0 END AS edge FROM s x JOIN s y ON x.g = y.g AND x.k < y.k")
def dm10(spark, folder):
    s = profiles(spark, folder).select("k", "g", R.style(F.col("strikes"), F.col("takedowns"), F.col("submissions")).alias("style"))
    return matchups.pairs(s, "k", "g").select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), R.style_advantage(F.col("a_style"), F.col("b_style")).alias("edge"))


IDLE = "(SELECT c_custkey AS k, c_custkey % 1200 AS days, 1500 + c_acctbal / 20 AS r FROM customer)"


@query("dm11_inactivity_brackets", f"""SELECT k, CASE WHEN days <= 180 THEN 0 ELSE greatest(trunc((r - 1500) * least(0.35, rate * (days / 365)))::INT + flat, flat) END::INT AS penalty
FROM (SELECT *, CASE WHEN days <= 365 THEN 0.08::DOUBLE WHEN days <= 540 THEN 0.12 WHEN days <= 730 THEN 0.18 ELSE 0.25 END AS rate, CASE WHEN days <= 365 THEN 10 WHEN days <= 540 THEN 20 WHEN days <= 730 THEN 30 ELSE 40 END AS flat FROM {IDLE})""")
def dm11(spark, folder):
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(k.alias("k"), R.inactivity_penalty(k % 1200, 1500 + F.col("c_acctbal") / 20).alias("penalty"))


@query("dm13_dm14_inactivity_variants", f"SELECT k, CASE WHEN days > 180 THEN trunc(greatest(r - 1500, 0) * least(0.05 * (days / 365), 0.25)) ELSE 0 END::INT AS live, CASE WHEN days > 180 THEN trunc((r - 1500) * least(0.05 * (days / 365), 0.25)) ELSE 0 END::INT AS signed FROM {IDLE}")
def dm13(spark, folder):
    k, r = F.col("c_custkey"), 1500 + F.col("c_acctbal") / 20
    return table(spark, folder, "customer").select(k.alias("k"), R.inactivity_live(k % 1200, r).alias("live"), R.inactivity_signed(k % 1200, r).alias("signed"))


@query("dm12_adjusted_ratings", """WITH last AS (SELECT o_custkey, max(o_orderdate)::DATE AS d FROM orders GROUP BY 1), x AS (SELECT c_custkey, 1500 + c_acctbal / 20 AS r, date_diff('day', d, DATE '2001-08-01') AS days FROM customer JOIN last ON c_custkey = o_custkey)
SELECT c_custkey, round(r - CASE WHEN days <= 180 THEN 0 ELSE greatest(trunc((r - 1500) * least(0.35, CASE WHEN days <= 365 THEN 0.08::DOUBLE WHEN days <= 540 THEN 0.12 WHEN days <= 730 THEN 0.18 ELSE 0.25 END * (days / 365))) + CASE WHEN days <= 365 THEN 10 WHEN days <= 540 THEN 20 WHEN days <= 730 THEN 30 ELSE 40 END, CASE WHEN days <= 365 THEN 10 WHEN days <= 540 THEN 20 WHEN days <= 730 THEN 30 ELSE 40 END) END, 4) AS adjusted FROM x""")
def dm12(spark, folder):
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("d"))
    days, r = F.datediff(F.lit("2001-08-01").cast("date"), "d"), 1500 + F.col("c_acctbal") / 20
    return table(spark, folder, "customer").join(last, "c_custkey").select("c_custkey", F.round(r - R.inactivity_penalty(days, r), 4).alias("adjusted"))


@query("dm15_injury_penalty", "SELECT event_id, CASE WHEN d > 540 THEN 0 ELSE trunc(CASE WHEN event_type = 'error' THEN 55 ELSE 25 END * CASE WHEN d <= 60 THEN 1.5::DOUBLE WHEN d <= 120 THEN 1.2 WHEN d <= 180 THEN 1.0 WHEN d <= 365 THEN 0.7 ELSE 0.3 END) END::INT AS penalty FROM (SELECT *, event_id % 700 AS d FROM events)")
def dm15(spark, folder):
    kind = F.when(F.col("event_type") == "error", "major").otherwise("minor")
    return table(spark, folder, "events").select("event_id", R.injury_penalty(kind, F.col("event_id") % 700).alias("penalty"))


@query("dm16_top_for_checking", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def dm16(spark, folder):
    """The 50 to check: the limit is the feature."""
    return table(spark, folder, "supplier").filter("s_acctbal > 0").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(50).select("s_suppkey")


# A mean to four decimals, half up, from whole ten-millionths, as their sum and number: in any order of summing the same.
_MEAN4 = "(sign({0}) * ((2 * abs({0}) + 1000 * {1}) // (2000 * {1})))::DOUBLE / 10000"


@query("dm17_schedule_strength", "WITH " + LONG + f""", o AS (SELECT entity, won, 1500 + s_acctbal / 20 AS r, round((1500 + s_acctbal / 20) * 10000000)::BIGINT::HUGEINT AS u, row_number() OVER (PARTITION BY entity ORDER BY d DESC, id DESC) AS n FROM side JOIN supplier ON opponent = s_suppkey),
t AS (SELECT entity, sum(u)::HUGEINT AS s, count(u)::HUGEINT AS c, (sum(u) FILTER (n <= 5))::HUGEINT AS s5, (count(u) FILTER (n <= 5))::HUGEINT AS c5, count(*) FILTER (won AND r >= 1650) AS elite_wins FROM o GROUP BY 1),
a AS (SELECT entity, {_MEAN4.format('s', 'nullif(c, 0)')} AS mean, {_MEAN4.format('s5', 'nullif(c5, 0)')} AS recent5, elite_wins FROM t) SELECT *, rank() OVER (ORDER BY mean DESC)::INT AS rank FROM a""")
def dm17(spark, folder):
    """Mean rating of the opponents, of all and of the last five; rounded exactly, since ranks tie on it."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("opponent"), (1500 + F.col("s_acctbal") / 20).alias("r"))
    o = long_form(contests(spark, folder)).join(s, "opponent").withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("d"), F.desc("id"))))
    u = F.round(F.col("r") * 10000000).cast("long").cast("decimal(20,0)")
    last = F.when(F.col("n") <= 5, u)
    a = o.groupBy("entity").agg(numbers.mean4(F.sum(u), F.count(u)).alias("mean"), numbers.mean4(F.sum(last), F.count(last)).alias("recent5"), F.count_if(F.col("won") & (F.col("r") >= 1650)).alias("elite_wins"))
    return ranks.ranked(stored(a), "mean")


@query("dm18_differentials", "WITH " + PROFILE + " SELECT x.k AS a, y.k AS b, round(x.balance - y.balance, 2) AS balance_diff, round(x.strikes - y.strikes, 2) AS strikes_diff, round(x.takedowns - y.takedowns, 2) AS takedowns_diff FROM profile x JOIN profile y ON x.g = y.g AND x.k < y.k")
def dm18(spark, folder):
    d = matchups.differentials(matchups.pairs(profiles(spark, folder), "k", "g"), ["balance", "strikes", "takedowns"])
    return d.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), "balance_diff", "strikes_diff", "takedowns_diff")


@query("dm20_training_matrix", "WITH " + LONG + f"""{', '}f AS (SELECT *, round(avg(won::INT) OVER (PARTITION BY entity ORDER BY d, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS form FROM side)
SELECT x.id, x.form AS form_a, y.form AS form_b, x.won FROM f x JOIN f y ON x.id = y.id AND NOT x.swapped AND y.swapped""")
def dm20(spark, folder):
    """Both sides' point-in-time form on one row a contest."""
    form = long_form(contests(spark, folder)).withColumn("form", r6(F.avg(F.col("won").cast("int")).over(H.before(3))))
    a = form.filter("not swapped").select("id", F.col("form").alias("form_a"), "won")
    return a.join(form.filter("swapped").select("id", F.col("form").alias("form_b")), "id")


@query("dm23_dm25_prepared_features", """WITH b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders WHERE o_orderdate < '2000-01-01'),
c AS (SELECT o_orderkey, o_orderdate, greatest(lo, least(hi, o_totalprice)) AS x FROM orders, b), m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM c WHERE o_orderdate < '2000-01-01') SELECT o_orderkey, round((x - m) / s, 6) AS o_totalprice FROM c, m""")
def dm23(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    ready = metrics.prepare(o.filter("o_orderdate < timestamp_ntz '2000-01-01'"), o, ["o_totalprice"])
    return ready.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@query("dm27_baseline_higher_rating", "WITH " + RATED + " SELECT count(*) AS n, round(avg(((ra > rb) = won)::INT), 6) AS accuracy FROM q")
def dm27(spark, folder):
    return rated(spark, folder).agg(F.count("*").alias("n"), r6(F.avg(((F.col("ra") > F.col("rb")) == F.col("won")).cast("int"))).alias("accuracy"))


@query("dm28_learners")
def dm28(spark, folder):
    """Logistic regression, random forest and boosted trees on point-in-time features; measured on later contests."""
    from ringledger.operators import learners

    form = long_form(contests(spark, folder)).withColumn("form", F.coalesce(F.avg(F.col("won").cast("int")).over(H.before(5)), F.lit(0.5)))
    a = form.filter("not swapped").select("id", "d", F.col("form").alias("form_a"), "won")
    both = a.join(form.filter("swapped").select("id", F.col("form").alias("form_b")), "id").join(rated(spark, folder).select("id", (F.col("ra") - F.col("rb")).alias("diff")), "id")
    return learners.compare(splits.by_position(both, ["d", "id"], [("train", 0.7), ("val", 0.85), ("holdout", 1.0)]), ["diff", "form_a", "form_b"], "won")


@query("dm31_scores", "WITH " + PREDICTION + """ SELECT count(*) AS n, round(avg(((p >= 0.5) = won)::INT), 6) AS accuracy, round(avg(pow(p - won::INT, 2)), 6) AS brier, round(avg(-(won::INT * ln(p) + (1 - won::INT) * ln(1 - p))), 6) AS log_loss FROM prediction""")
def dm31(spark, folder):
    s = metrics.scores(predictions(spark, folder), y="won")
    return s.select("n", *(r6(c).alias(c) for c in ("accuracy", "brier", "log_loss")))


@query("dm31_auc", "WITH " + PREDICTION + ", r AS (SELECT won, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rank FROM prediction) SELECT round((sum(rank) FILTER (won) - count(*) FILTER (won) * (count(*) FILTER (won) + 1) / 2) / (count(*) FILTER (won) * count(*) FILTER (NOT won)), 6) AS auc FROM r")
def dm31b(spark, folder):
    return metrics.auc(predictions(spark, folder), y="won").select(r6("auc").alias("auc"))


@query("dm36_blend", "WITH " + RATED + """ SELECT id, round(greatest(0.10, least(0.90, w * m + (1 - w) * p)), 6) AS p FROM (SELECT id, p, m, CASE WHEN s <= 0.60 AND k <= 6 THEN greatest(0.15, least(0.50, 0.50 - 0.08 * k - 0.60 * greatest(s - 0.20, 0))) ELSE 0 END AS w
FROM (SELECT id, p, 0.3 + (id % 40) / 100.0::DOUBLE AS m, (id % 70) / 100.0::DOUBLE AS s, id % 8 AS k FROM q))""")
def dm36(spark, folder):
    i = F.col("id")
    return rated(spark, folder).select("id", r6(MK.blend(0.3 + (i % 40) / 100.0, F.col("p"), (i % 70) / 100.0, i % 8)).alias("p"))


@query("dm38_shares", "WITH " + PROFILE + " SELECT x.k AS a, y.k AS b, round(CASE WHEN x.strikes + y.strikes = 0 THEN 0.5 ELSE x.strikes / (x.strikes + y.strikes) END, 6) AS strikes FROM profile x JOIN profile y ON x.g = y.g AND x.k < y.k")
def dm38(spark, folder):
    p = matchups.pairs(profiles(spark, folder), "k", "g")
    return p.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), r6(MK.share_of_two(F.col("a_strikes"), F.col("b_strikes"))).alias("strikes"))


@query("dm39_method_split", "WITH " + PROFILE + """, x AS (SELECT k, strikes / 6 * 0.3 AS power, submissions / 2 * 0.3 AS threat, CASE WHEN k % 90 = 0 THEN 0.5 ELSE (k % 90) / 100.0::DOUBLE END AS base FROM profile)
SELECT k, round(power * (1 - base) / t, 6) AS ko, round(threat * (1 - base) / t, 6) AS sub, round(base / t, 6) AS "dec" FROM (SELECT *, power * (1 - base) + threat * (1 - base) + base AS t FROM x)""")
def dm39(spark, folder):
    s = MK.method_split(F.col("strikes") / 6 * 0.3, F.col("submissions") / 2 * 0.3, (F.col("k") % 90).cast("double"))
    return profiles(spark, folder).select("k", *(r6(s[x]).alias(x) for x in ("ko", "sub", "dec")))


@query("dm41_upset_score", "WITH " + RATED + " SELECT id, round(least(0.65, least(p, 1 - p) + 0.15 * (0.20 * (id % 10) / 10 + 0.25 * (na % 5) / 5 + 0.25 * (nb % 5) / 5 + 0.15 * (id % 7) / 7 + 0.15 * (id % 3) / 3)), 6) AS underdog FROM q")
def dm41(spark, folder):
    i = F.col("id")
    parts = (0.20, i % 10, 10), (0.25, F.col("na") % 5, 5), (0.25, F.col("nb") % 5, 5), (0.15, i % 7, 7), (0.15, i % 3, 3)
    raw = sum((F.lit(w) * x / n for w, x, n in parts), F.lit(0.0))
    return rated(spark, folder).select("id", r6(F.least(F.lit(0.65), F.least("p", 1 - F.col("p")) + 0.15 * raw)).alias("underdog"))


ODDS = RATED + """, o AS (SELECT *, 1 / greatest(0.05, least(0.95, p * 1.025)) AS decimal_a, 1 / greatest(0.05, least(0.95, (1 - p) * 1.025)) AS decimal_b, greatest(0.05, least(0.95, p + ((id % 21) - 10) / 100.0::DOUBLE)) AS m FROM q),
bets AS (SELECT id, 'a' AS side, won, decimal_a AS decimal, m * (decimal_a - 1) - (1 - m) AS edge FROM o UNION ALL SELECT id, 'b', NOT won, decimal_b, (1 - m) * (decimal_b - 1) - m FROM o)"""


def odds(spark, folder):
    a, b = MK.simulated_odds(F.col("ra") - F.col("rb"))
    model = MK.clamp(F.col("p") + (F.col("id") % 21 - 10) / 100.0, 0.05, 0.95)
    return rated(spark, folder).withColumns({"decimal_a": a, "decimal_b": b, "m": model})


def placed(spark, folder, least):
    bets = markets.value_bets(odds(spark, folder), p="m", least_edge=least)
    return bets.withColumn("hit", F.when(F.col("side") == "a", F.col("won")).otherwise(~F.col("won")))


@query("dm43_simulated_odds", "WITH " + ODDS + " SELECT id, round(decimal_a, 6) AS decimal_a, round(decimal_b, 6) AS decimal_b FROM o")
def dm43(spark, folder):
    return odds(spark, folder).select("id", r6("decimal_a").alias("decimal_a"), r6("decimal_b").alias("decimal_b"))


@query("dm44_value_bets", "WITH " + ODDS + " SELECT id, side, round(edge, 6) AS edge FROM bets WHERE edge > 0.03")
def dm44(spark, folder):
    return placed(spark, folder, 0.03).select("id", "side", r6("edge").alias("edge"))


@query("dm45_edge_sources", "WITH " + ODDS + " SELECT CASE WHEN decimal > 2 THEN 'underdog' ELSE 'favourite' END AS kind, count(*) AS n, round(avg(won::INT), 6) AS rate, round(sum(CASE WHEN won THEN decimal - 1 ELSE -1 END) / count(*), 6) AS roi FROM bets WHERE edge > 0.03 GROUP BY 1")
def dm45(spark, folder):
    rows = placed(spark, folder, 0.03).withColumn("kind", F.when(F.col("decimal") > 2, "underdog").otherwise("favourite"))
    out = markets.returns(rows, won="hit", keys=["kind"])
    return out.select("kind", "n", r6("rate").alias("rate"), r6("roi").alias("roi"))


@query("dm46_edge_sweep", "WITH " + ODDS + " SELECT t AS threshold, count(*) AS n, round(sum(CASE WHEN won THEN decimal - 1 ELSE -1 END) / count(*), 6) AS roi FROM bets, (VALUES (0.02::DOUBLE), (0.03), (0.05), (0.08)) v(t) WHERE edge >= t GROUP BY 1")
def dm46(spark, folder):
    profit = MK.profit(F.col("hit"), F.col("decimal"))
    return metrics.by_threshold(placed(spark, folder, 0.0), "edge", [0.02, 0.03, 0.05, 0.08], [F.count("*").alias("n"), r6(F.sum(profit) / F.count("*")).alias("roi")])


@query("dm47_strategies", "WITH " + ODDS + ", s AS (SELECT 'favourite' AS strategy, CASE WHEN p >= 0.5 THEN won ELSE NOT won END AS hit, CASE WHEN p >= 0.5 THEN decimal_a ELSE decimal_b END AS decimal FROM o UNION ALL SELECT 'first', won, decimal_a FROM o WHERE m > 0.55) SELECT strategy, count(*) AS n, round(sum(CASE WHEN hit THEN decimal - 1 ELSE -1 END), 4) AS profit FROM s GROUP BY 1")
def dm47(spark, folder):
    bet = lambda side, decimal: F.struct(F.lit(side).alias("side"), F.col(decimal).alias("decimal"))
    plans = {"favourite": lambda: F.when(F.col("p") >= 0.5, bet("a", "decimal_a")).otherwise(bet("b", "decimal_b")), "first": lambda: F.when(F.col("m") > 0.55, bet("a", "decimal_a"))}
    return markets.by_strategy(odds(spark, folder), plans).select("strategy", "n", F.round("profit", 4).alias("profit"))


@query("dm48_flat_odds", "WITH " + PREDICTION + " SELECT count(*) AS n, round(sum(CASE WHEN won THEN 0.91::DOUBLE ELSE -1 END) / count(*), 6) AS roi FROM prediction WHERE p >= 0.574")
def dm48(spark, folder):
    rows = predictions(spark, folder).filter("p >= 0.574").withColumn("decimal", F.lit(1.91))
    return markets.returns(rows).select("n", r6("roi").alias("roi"))


@query("dm49_roi_by_year", "WITH " + PREDICTION + " SELECT year(d)::INT AS year, count(*) AS n, round(sum(CASE WHEN won THEN 0.91::DOUBLE ELSE -1 END) / count(*), 6) AS roi FROM prediction GROUP BY 1")
def dm49(spark, folder):
    rows = predictions(spark, folder).withColumns({"decimal": F.lit(1.91), "year": F.year("d")})
    return markets.returns(rows, keys=["year"]).select("year", "n", r6("roi").alias("roi"))


@query("dm50_bias_study", "WITH " + RATED + " SELECT CASE WHEN na = nb THEN 'same' WHEN na < nb THEN 'lower' ELSE 'higher' END AS segment, count(*) AS n, round(avg(won::INT), 6) AS rate, round(avg(p), 6) AS expected, round(avg(won::INT) - avg(p), 6) AS edge FROM q GROUP BY 1 HAVING count(*) >= 20")
def dm50(spark, folder):
    seg = F.when(F.col("na") == F.col("nb"), "same").when(F.col("na") < F.col("nb"), "lower").otherwise("higher")
    out = markets.bias_study(rated(spark, folder), seg)
    return out.select("segment", "n", *(r6(c).alias(c) for c in ("rate", "expected", "edge")))


@query("dm51_position_bias", "WITH " + CONTEST + " SELECT count(*) AS n, count(*) FILTER (winner = a) AS first, round(pow(2 * count(*) FILTER (winner = a) - count(*), 2) / count(*), 6) AS chi2 FROM contest")
def dm51(spark, folder):
    k, n = F.count_if(F.col("winner") == F.col("a")), F.count("*")
    return contests(spark, folder).agg(n.alias("n"), k.alias("first"), r6(stats.chi_square_even(k, n)).alias("chi2"))


@query("dm53_by_region", "WITH " + LONG + " SELECT r_name, count(*) AS n, round(avg(won::INT), 6) AS rate FROM side JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def dm53(spark, folder):
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    place = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("entity"), "r_name")
    return long_form(contests(spark, folder)).join(place, "entity").groupBy("r_name").agg(F.count("*").alias("n"), r6(F.avg(F.col("won").cast("int"))).alias("rate"))


@query("dm55_sample_gate", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) < 10 THEN 'insufficient' WHEN count(*) < 20 THEN 'borderline' ELSE 'sufficient' END AS gate FROM orders GROUP BY 1")
def dm55(spark, folder):
    n = F.count("*")
    gate = F.when(n < 10, "insufficient").when(n < 20, "borderline").otherwise("sufficient")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(n.alias("n"), gate.alias("gate"))


TESTS = "t AS (SELECT s_suppkey::VARCHAR AS name, (s_suppkey % 50) * (s_suppkey % 50) / 250000.0::DOUBLE AS p_value FROM supplier)"


@query("dm56_multiple_tests", "WITH " + TESTS + ", r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value, name) - 1 AS i FROM t) SELECT name, p_value < 0.05::DOUBLE / n AS bonferroni, bool_and(p_value < 0.05::DOUBLE / (n - i)) OVER (ORDER BY p_value, name) AS holm FROM r")
def dm56(spark, folder):
    k = F.col("s_suppkey") % 50
    tests = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), (k * k / 250000.0).alias("p_value"))
    return stats.corrected(tests).select("name", "bonferroni", "holm")


@query("dm57_kelly", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN e >= 0.03 AND f > 0 THEN least(0.25 * f, 0.05) ELSE 0 END, 6) AS stake FROM (SELECT *, (b * p - (1 - p)) / b AS f FROM (SELECT *, l_discount * 0.7 AS e, 0.5 + l_tax * 10 AS b, 1 / (1.5 + l_tax * 10) + l_discount * 0.7 AS p FROM lineitem))")
def dm57(spark, folder):
    stake = MK.kelly(F.col("l_discount"), 1.5 + F.col("l_tax") * 10)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(stake).alias("stake"))


@query("dm59_wilson", "SELECT o_custkey, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lo, round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS hi FROM (SELECT o_custkey, count(*)::DOUBLE AS n, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1)")
def dm59(spark, folder):
    each = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return each.select("o_custkey", r6(w["lo"]).alias("lo"), r6(w["hi"]).alias("hi"))


@query("dm59_binomial_tail", """WITH e AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, round(1e-9 + least(1, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))), 6) AS tail FROM e""")
def dm59b(spark, folder):
    each = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    return each.select("o_custkey", r6(1e-9 + stats.binomial_tail("k", "n", F.lit(0.5))).alias("tail"))


@query("dm61_backtest", "WITH " + LONG + """, f AS (SELECT id, d, entity, won, swapped, coalesce(avg(won::INT) OVER (PARTITION BY entity ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) AS form FROM side),
x AS (SELECT a.id, a.d, a.won, greatest(0.1, least(0.9, 0.5 + (a.form - b.form) / 2)) AS p FROM f a JOIN f b ON a.id = b.id AND NOT a.swapped AND b.swapped)
SELECT year(d)::INT AS year, count(*) AS n, round(avg(((p >= 0.5) = won)::INT), 6) AS accuracy FROM x WHERE d >= '1998-01-01' GROUP BY 1""")
def dm61(spark, folder):
    form = long_form(contests(spark, folder)).withColumn("form", F.coalesce(F.avg(F.col("won").cast("int")).over(H.before(5)), F.lit(0.5)))
    a = form.filter("not swapped").select("id", "d", "won", "form")
    x = a.join(form.filter("swapped").select("id", F.col("form").alias("other")), "id").filter("d >= timestamp_ntz '1998-01-01'")
    p = MK.clamp(0.5 + (F.col("form") - F.col("other")) / 2, 0.1, 0.9)
    return metrics.scores(x.select(F.year("d").alias("year"), p.alias("p"), "won"), y="won", keys=["year"]).select("year", "n", r6("accuracy").alias("accuracy"))


@query("dm64_resolve_by_pair", "WITH " + CONTEST + ", p AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, arg_max(winner, (d, id)) AS winner FROM contest GROUP BY 1, 2) SELECT c.id, p.winner FROM contest c JOIN p ON least(a, b) = lo AND greatest(a, b) = hi")
def dm64(spark, folder):
    c = contests(spark, folder).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    last = c.groupBy("lo", "hi").agg(F.max_by("winner", F.struct("d", "id")).alias("last"))
    return c.select("id", "lo", "hi").join(last, ["lo", "hi"]).select("id", F.col("last").alias("winner"))


@query("dm65_compare_kinds", "WITH " + PREDICTION + " SELECT round(avg(won::INT) FILTER (kind = '1-URGENT'), 6) AS urgent, round(avg(won::INT) FILTER (kind = '5-LOW'), 6) AS low, CASE WHEN abs(avg(won::INT) FILTER (kind = '1-URGENT') - avg(won::INT) FILTER (kind = '5-LOW')) < 0.05 THEN 'consistent' ELSE 'check' END AS status FROM prediction")
def dm65(spark, folder):
    w = F.col("won").cast("int")
    rows = predictions(spark, folder).agg(*(F.avg(F.when(F.col("kind") == k, w)).alias(n) for k, n in (("1-URGENT", "urgent"), ("5-LOW", "low"))))
    status = F.when(F.abs(F.col("urgent") - F.col("low")) < 0.05, "consistent").otherwise("check")
    return rows.select(r6("urgent").alias("urgent"), r6("low").alias("low"), status.alias("status"))


@query("dm66_constancy_check", "SELECT s_suppkey FROM supplier WHERE false UNION ALL SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_tax) > 8")
def dm66(spark, folder):
    """Keys with too many values of what should not change."""
    rows = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_tax").alias("k")).filter("k > 8")
    return rows.select(F.col("l_partkey").alias("s_suppkey"))


@query("dm68_missing_ratings", "SELECT count(*) AS n, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing FROM customer")
def dm68(spark, folder):
    c = rules.coverage(table(spark, folder, "customer"), table(spark, folder, "orders"), "c_custkey", "o_custkey")
    return c.select("n", (F.col("n") - F.col("covered")).alias("missing"))


@query("dm69_lookup_consistency", "WITH " + HISTORY + ", p AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY d, id) AS before FROM history) SELECT count(*) AS n, count(before) AS with_prior FROM p")
def dm69(spark, folder):
    h = history(spark, folder)
    found = asof.asof(h.select("entity", "d", "id"), h.select("entity", "d", "id", "value"), "entity", "d", ["value"], "id", strict=True)
    same_day = h.groupBy("entity", "d").agg(F.count("*").alias("k"))
    extra = same_day.join(h.groupBy("entity").agg(F.min("d").alias("d0")), "entity").filter("d = d0").agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("x"))
    return found.agg(F.count("*").alias("n"), F.count("asof_value").alias("w")).join(extra, F.lit(True)).select("n", (F.col("w") + F.col("x")).alias("with_prior"))


@query("dm76_false_positives", "SELECT o_custkey, CASE WHEN count(*) > 5 THEN round(count(*) * 0.05, 6)::DOUBLE END AS expected FROM orders GROUP BY 1")
def dm76(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", r6(stats.false_positives(F.col("n"))).alias("expected"))


@query("dm77_worst_misses", "WITH " + PREDICTION + " SELECT kind, id FROM prediction WHERE NOT won QUALIFY row_number() OVER (PARTITION BY kind ORDER BY p DESC, id) <= 5")
def dm77(spark, folder):
    """The five most confident misses of each kind."""
    return keyed.first_per_key(predictions(spark, folder).filter("not won"), ["kind"], [F.desc("p"), "id"], 5).select("kind", "id")


@query("dm79_style_counts", "WITH " + PROFILE + f" SELECT {STYLE} AS style, count(*) AS n FROM profile WHERE strikes IS NOT NULL GROUP BY 1")
def dm79(spark, folder):
    style = R.style(F.col("strikes"), F.col("takedowns"), F.col("submissions"))
    return profiles(spark, folder).filter("strikes is not null").groupBy(style.alias("style")).agg(F.count("*").alias("n"))


@query("dm85_side_by_side", "WITH " + PROFILE + " SELECT x.k AS a, y.k AS b, CASE WHEN x.balance > y.balance THEN 'a' WHEN x.balance < y.balance THEN 'b' ELSE 'even' END AS better FROM profile x JOIN profile y ON x.g = y.g AND x.k < y.k")
def dm85(spark, folder):
    p = matchups.pairs(profiles(spark, folder), "k", "g")
    better = F.when(F.col("a_balance") > F.col("b_balance"), "a").when(F.col("a_balance") < F.col("b_balance"), "b").otherwise("even")
    return p.select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), better.alias("better"))


@query("dm87_upsert_counters", "SELECT count(*) FILTER (s_suppkey + 50 NOT IN (SELECT s_suppkey FROM supplier)) AS new, count(*) FILTER (s_suppkey + 50 IN (SELECT s_suppkey FROM supplier)) AS updated FROM supplier")
def dm87(spark, folder):
    base = table(spark, folder, "supplier").select("s_suppkey")
    delta = base.select((F.col("s_suppkey") + 50).alias("s_suppkey"))
    known = base.withColumn("old", F.lit(1))
    return delta.join(known, "s_suppkey", "left").agg(F.count_if(F.col("old").isNull()).alias("new"), F.count_if(F.col("old").isNotNull()).alias("updated"))


@query("dm0_flagship_region_features", "WITH " + LONG + """, f AS (SELECT *, avg(won::INT) OVER (PARTITION BY entity ORDER BY d, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS form3, avg(won::INT) OVER (PARTITION BY entity ORDER BY d, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS form5 FROM side)
SELECT r_name, count(*) AS n, round(avg(form3), 6) AS form3, round(avg(form5), 6) AS form5, round(avg(won::INT), 6) AS rate FROM f JOIN supplier ON entity = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def flagship(spark, folder):
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    place = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("entity"), "r_name")
    won = F.col("won").cast("int")
    f = long_form(contests(spark, folder)).withColumns({"form3": F.avg(won).over(H.before(3)), "form5": F.avg(won).over(H.before(5))})
    return f.join(place, "entity").groupBy("r_name").agg(F.count("*").alias("n"), r6(F.avg("form3")).alias("form3"), r6(F.avg("form5")).alias("form5"), r6(F.avg(won)).alias("rate"))
