"""The model path: folds, calibration, stacking, bundles, importance, the production path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringledger.operators import cards, ensemble, forests, importance, production, progress
from ringledger.operators.isotonic import Calibrator
from ringledger.sources import bundles, pointers
from ringledger.sources.files import scratch, stored

COLUMNS = ["strong", "useless"]


def rows_of(spark, n=400, seed=1):
    """Both orientations of n contests; `strong` decides most of them."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        won = r.random() < 1 / (1 + np.exp(-2.5 * x))
        for swapped, sign in ((False, 1), (True, -1)):
            out.append((i, swapped, sign * x, sign * z, float(won != swapped)))
    df = spark.createDataFrame(out, "id long, swapped boolean, strong double, useless double, label double")
    return stored(df.withColumn("d", F.expr("timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, cast(id / 3 as int))")))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ensemble, "LEARNERS", {"logistic": ensemble.logistic, "forest": lambda n: ensemble.forest(8, 3), "boosted": lambda n: ensemble.boosted(6, 2)})


@pytest.fixture(scope="module")
def folded(spark):
    return stored(ensemble.in_folds(rows_of(spark), 5))


def test_folds_are_blocks_of_time(folded):
    ends = folded.groupBy("fold").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).orderBy("fold").collect()
    assert [r["fold"] for r in ends] == [0, 1, 2, 3, 4] and all(r["n"] == 160 for r in ends)
    assert all(a["hi"] < b["lo"] for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_no_fold_is_scored_by_a_model_that_saw_it(folded, small, monkeypatch):
    learnt = {}
    real = ensemble.fitted

    def spy(rows, columns, learner):
        model = real(rows, columns, learner)
        learnt[model.uid] = {r["id"] for r in rows.select("id").distinct().collect()}
        return model

    monkeypatch.setattr(ensemble, "fitted", spy)
    models = ensemble.fold_models(folded, COLUMNS, ["logistic", "forest"])
    for each in models.values():
        for k, model in enumerate(each):
            own = {r["id"] for r in folded.filter(F.col("fold") == k).select("id").collect()}
            assert not own & learnt[model.uid] and len(own | learnt[model.uid]) == 400
    told = ensemble.out_of_fold(folded, models)
    assert told.count() == 800
    one = told.filter("fold = 2 and id = 200 and not swapped").first()
    again = ensemble.scored(folded.filter("id = 200 and not swapped"), models["forest"][2]).first()
    assert one["p_forest"] == again["p"]


def test_calibrated_folds_are_a_mean_of_interpolations(spark, folded, small):
    models = ensemble.fold_models(folded, COLUMNS, ["logistic"])["logistic"]
    fit = ensemble.CalibratedFolds.fit(folded, models)
    later = rows_of(spark, 60, seed=9)
    got = {(r["id"], r["swapped"]): r["p"] for r in fit.predict(later).collect()}
    want = {k: 0.0 for k in got}
    for k, model in enumerate(models):
        data = [(r["p"], r["label"]) for r in ensemble.scored(folded.filter(F.col("fold") == k), model).collect()]
        xs, vs = brute_isotonic(data)
        for r in ensemble.scored(later, model).collect():
            want[(r["id"], r["swapped"])] += np.interp(r["p"], xs, vs) / 5
    assert got == pytest.approx(want)


def brute_isotonic(data):
    xs = sorted({p for p, _ in data})
    blocks = [[[x], [y for p, y in data if p == x]] for x in xs]
    i = 0
    while i + 1 < len(blocks):
        if np.mean(blocks[i][1]) >= np.mean(blocks[i + 1][1]):
            blocks[i : i + 2] = [[blocks[i][0] + blocks[i + 1][0], blocks[i][1] + blocks[i + 1][1]]]
            i = max(0, i - 1)
        else:
            i += 1
    return [x for b in blocks for x in b[0]], [float(np.mean(b[1])) for b in blocks for _ in b[0]]


def test_stack_learns_from_out_of_fold_scores(spark, folded, small):
    stack = ensemble.Stack.fit(folded, COLUMNS, ensemble.fold_models(folded, COLUMNS, list(ensemble.LEARNERS)))
    later = rows_of(spark, 150, seed=5)
    told = stored(stack.predict(later))
    assert set(told.columns) == {*later.columns, "p_logistic", "p_forest", "p_boosted", "p"}
    scores = {n: ensemble.measured(told, n, c).first() for n, c in (("logistic", "p_logistic"), ("forest", "p_forest"), ("stack", "p"))}
    assert all(s["n"] == 150 and s["auc"] > 0.75 for s in scores.values())
    table = ensemble.verdicts(ensemble.measured(stack.predict(folded), "stack"), ensemble.measured(told, "stack")).first()
    assert table["best"] and table["status"] in ("OK", "WARNING", "OVERFITTING") and abs(table["gap"] - (table["train_auc"] - table["auc"])) < 1e-12


@pytest.fixture(scope="module")
def made(spark):
    """A forest on rows with holes and outliers, and its parts."""
    rows = rows_of(spark)
    rows = stored(rows.withColumn("strong", F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 51 == 0, 1e6).otherwise(F.col("strong"))))
    preparation = bundles.Preparation.of(rows, COLUMNS)
    model = ensemble.fitted(preparation.apply(rows), COLUMNS, ensemble.forest(8, 3))
    return rows, preparation, model, Calibrator.fit(ensemble.scored(preparation.apply(rows), model))


def test_bundle_in_a_new_session(spark, made):
    rows, preparation, model, calibrator = made
    home = scratch(spark)
    version = bundles.save(spark, home, model, preparation, calibrator, dropped=["third"], metrics={"auc": 0.9})
    scores = lambda b, x: {(r["id"], r["swapped"]): (r["raw_p"], r["p"]) for r in b.predict(x).collect()}
    before = scores(bundles.Bundle(version, model, preparation, calibrator), rows)
    other = spark.newSession()
    bundle = bundles.load(other, home, features=COLUMNS)
    assert bundle.version == version and bundle.metadata["dropped"] == ["third"] and bundle.metadata["metrics"] == {"auc": 0.9}
    path = scratch(spark)
    rows.write.parquet(path)
    assert scores(bundle, other.read.parquet(path)) == before
    assert all(0.1 <= p <= 0.9 for _, p in before.values())


def test_bundle_refuses_another_order_and_moves_in_one_step(spark, made, monkeypatch):
    rows, preparation, model, calibrator = made
    home = scratch(spark)
    with pytest.raises(FileNotFoundError):
        bundles.load(spark, home)
    first = bundles.save(spark, home, model, preparation, calibrator)
    with pytest.raises(ValueError):
        bundles.load(spark, home, features=COLUMNS[::-1])
    second = bundles.save(spark, home, model, preparation, calibrator)
    assert bundles.load(spark, home).version == second and bundles.load(spark, home, first).version == first
    real = pointers.replace
    monkeypatch.setattr(pointers, "replace", lambda s, path, text: (_ for _ in ()).throw(OSError()) if path.endswith("metadata.json") else real(s, path, text))
    with pytest.raises(OSError):
        bundles.save(spark, home, model, preparation, calibrator)
    monkeypatch.undo()
    assert bundles.load(spark, home).version == second and sorted(bundles.versions(spark, home)) == sorted([first, second])


def test_preparation_clips_fills_and_adds_missing_columns(spark):
    train = spark.createDataFrame([(float(i), float(i)) for i in range(101)] + [(None, None)], "a double, b double")
    ready = bundles.Preparation.of(train, ["b", "a"])
    got = ready.apply(spark.createDataFrame([(-50.0,), (1e9,), (None,), (float("nan"),), (7.0,)], "a double")).select("a", "b").collect()
    assert [tuple(r) for r in got] == [(1.0, 50.0), (99.0, 50.0), (50.0, 50.0), (50.0, 50.0), (7.0, 50.0)]


def test_importance_of_a_strong_and_a_useless_column(spark):
    rows = rows_of(spark).filter("not swapped")
    model = ensemble.fitted(rows, COLUMNS, ensemble.forest(8, 3))
    got = {r["feature"]: r for r in importance.report(rows, COLUMNS, model, lambda x: ensemble.scored(x, model), "id", repeats=4).collect()}
    assert got["strong"]["loss"] > 0.2 > 0.05 > abs(got["useless"]["loss"]) and got["strong"]["gain"] > 0.7 > got["useless"]["gain"]
    assert abs(sum(r["gain"] for r in got.values()) - 1) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation(spark, n):
    for seed in (0, 1):
        to = [r[0] for r in spark.range(n).select(importance.shuffled(F.col("id"), n, seed)).collect()]
        assert sorted(to) == list(range(n))
    placed = importance.numbered(spark.range(n).withColumn("k", F.col("id") * 3), n, "k", "number")
    assert sorted(r["number"] for r in placed.collect()) == list(range(n))


def test_auc_by_key(spark):
    r = random.Random(2)
    data = [(k, round(r.random(), 1), r.random() < 0.5) for k in ("a", "b", None) for _ in range(50)]
    got = {x["k"]: x["auc"] for x in importance.auc_by(spark.createDataFrame(data, "k string, p double, y boolean"), ["k"], "p", "y", buckets=7).collect()}
    for k in ("a", "b", None):
        pos, neg = ([p for kk, p, y in data if kk == k and y == side] for side in (True, False))
        assert got[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def contest_rows(spark, n=300):
    r = random.Random(6)
    data = []
    for i in range(n):
        a, b = r.sample(range(12), 2)
        data.append((i, a, b, a if r.random() < 0.3 + 0.05 * a else b))
    df = spark.createDataFrame(data, "id long, a long, b long, winner long")
    return stored(df.withColumn("d", F.expr("timestamp_ntz '2021-01-01' + make_interval(0, 0, 0, cast(id / 4 as int))")))


def test_production_path_equals_training_and_tells_look_ahead(spark):
    contests = contest_rows(spark)
    ratings = spark.createDataFrame([(e, 1500.0 + 10 * e) for e in range(11)], "entity long, rating double")  # one has none
    rows = stored(production.training_features(contests, ratings))
    assert rows.count() == 600
    preparation = bundles.Preparation.of(rows, production.FEATURES)
    model = ensemble.fitted(preparation.apply(rows), production.FEATURES, ensemble.forest(6, 3))
    bundle = bundles.Bundle("x", model, preparation, Calibrator([0.0, 1.0], [0.0, 1.0]))
    later = contests.filter("id >= 200")
    good = stored(production.replay(bundle, later, contests, ratings, rows.filter("id >= 200")))
    assert good.count() == 100 and good.filter("differs").count() == 0
    planted = production.training_features(contests, ratings, look_ahead=True)
    assert production.replay(bundle, later, contests, ratings, planted.filter("id >= 200")).filter("differs").count() > 50
    blocks = production.by_block(good, days=10).collect()
    assert sum(b["n"] for b in blocks) == 100 and all(b["p_accuracy"] == b["trained_p_accuracy"] for b in blocks)


def test_profiles_by_hand(spark):
    """What production knows of a side before a contest, counted in plain Python."""
    contests = contest_rows(spark, 120)
    ratings = spark.createDataFrame([(e, 0.0) for e in range(12)], "entity long, rating double")
    got = {(r["id"], r["swapped"]): r for r in production.replayed_features(contests, contests, ratings).collect()}
    seen = {e: [] for e in range(12)}
    for c in contests.orderBy("d", "id").collect():
        known = {}
        for e in (c["a"], c["b"]):
            h = seen[e]
            streak = next((i for i, w in enumerate(reversed(h)) if not w), len(h))
            known[e] = (np.mean(h[-5:]) if h else 0.5, np.mean(h[-3:]) if h else 0.5, len(h), streak)
        for swapped, x, y in ((False, c["a"], c["b"]), (True, c["b"], c["a"])):
            row = got[(c["id"], swapped)]
            assert [row[f"{n}_diff"] for n in production.PROFILE] == pytest.approx([p - q for p, q in zip(known[x], known[y], strict=True)])
            assert row["label"] == float(c["winner"] == x)
        for e in (c["a"], c["b"]):
            seen[e].append(c["winner"] == e)


def test_card_by_hand(spark):
    """The blend, the penalty shift and the bets of a card against the formulas in plain Python."""
    contests = contest_rows(spark, 60)
    ratings = spark.createDataFrame([(e, 1500.0 + 30 * e) for e in range(11)], "entity long, rating double")
    penalties = spark.createDataFrame([(1, 40.0), (3, 500.0)], "entity long, penalty double")
    rows = stored(production.training_features(contests, ratings))
    preparation = bundles.Preparation.of(rows, production.FEATURES)
    bundle = bundles.Bundle("x", ensemble.fitted(preparation.apply(rows), production.FEATURES, ensemble.forest(6, 3)), preparation, Calibrator([0.0, 1.0], [0.0, 1.0]))
    some = rows.filter("id < 50")  # the others have no features
    said = {r["id"]: r for r in production.one_probability(bundle, some).collect()}
    gaps = {r["id"]: sum(r[c] is None for c in production.FEATURES) for r in some.filter("not swapped").collect()}
    card = stored(cards.predicted(bundle, some, contests, ratings, penalties))
    rating = lambda e: 1500.0 + 30 * e if e < 11 else 1500.0
    clamp = lambda x, lo, hi: max(lo, min(hi, x))
    pen = {1: 40.0, 3: 500.0}
    got = card.collect()
    assert len(got) == 60
    for r in got:
        q = 1 / (1 + 10 ** ((rating(r["b"]) - rating(r["a"])) / 400))
        p = q
        if r["id"] in said:
            s = said[r["id"]]
            w = clamp(0.5 - 0.08 * gaps[r["id"]] - 0.6 * max(s["symmetry"] - 0.2, 0), 0.15, 0.5) if s["symmetry"] <= 0.6 and gaps[r["id"]] <= 6 else 0
            p = w * s["p"] + (1 - w) * q
            assert r["weighted"] == (w > 0) and r["model_p"] == s["p"]
        p = clamp(clamp(p, 0.1, 0.9) - min(pen.get(r["a"], 0) / 800, 0.1) + min(pen.get(r["b"], 0) / 800, 0.1), 0.1, 0.9)
        assert r["p"] == pytest.approx(p) and r["pick"] == (r["a"] if r["p"] >= 0.5 else r["b"])
    odds = spark.createDataFrame([(i, 3.0, 1.4) for i in range(30)], "id long, decimal_a double, decimal_b double")
    for r in cards.with_bets(card, odds).collect():
        side = None if r["id"] >= 30 else "a" if r["p"] - 1 / 3 > 0.05 else "b" if 1 - r["p"] - 1 / 1.4 > 0.05 else None
        assert r["bet_on"] == side and (r["stake"] is None) == (side is None) and (side is None or 0 <= r["stake"] <= 0.05)


def test_models_go_to_executors_after_an_observation(spark):
    """An observation gives the session a part that can't be sent; fitted models must not hold the session."""
    seen, counted = progress.observed(spark.range(3), "before", n=F.count(F.lit(1)))
    seen.write.format("noop").mode("overwrite").save()
    assert counted.get == {"n": 3}
    rows = rows_of(spark, 60)
    for learner in (ensemble.logistic(120), ensemble.forest(4, 2), ensemble.boosted(3, 2)):
        assert ensemble.scored(rows, ensemble.fitted(rows, COLUMNS, learner)).groupBy((F.col("p") > 0.5).alias("x")).count().count() >= 1


def test_learners_go_over_partitions_of_bounded_size(spark):
    rows = spark.range(1000, numPartitions=2).withColumn("x", F.rand(1))
    parts = ensemble.spread(rows, per=100)
    assert parts.rdd.getNumPartitions() == 10 and sorted(r["id"] for r in parts.select("id").collect()) == list(range(1000))
    assert ensemble.spread(rows, per=100_000).rdd.getNumPartitions() == 2


def repeating(spark, n=6000):
    """Rows of few distinct values, two of which decide."""
    r = random.Random(3)
    data = [(i, float(r.randint(-3, 3)), float(r.randint(-4, 4)), round(r.gauss(0, 1) * 2) / 2) for i in range(n)]
    data = [(i, x, z, u, float(r.random() < 1 / (1 + np.exp(-0.5 * x - 0.4 * (z % 3) - 0.5 * u)))) for i, x, z, u in data]
    return stored(spark.createDataFrame(data, "id long, x double, z double, u double, label double"))


def test_forest_from_counts_is_one_from_rows(spark):
    """Fitted on counts of equal rows, a forest differs from Spark's on the rows no more than by another seed, and keeps its sizes."""
    rows, columns = repeating(spark), ["x", "z", "u"]
    counts = forests.counted(rows, forests.bins(rows, columns))
    assert counts.agg(F.sum("n")).first()[0] == 6000 > 4 * counts.count()
    learner = lambda: ensemble.forest(25, 4)
    other = learner()
    other.setSeed(7)
    made = {"counts": ensemble.fitted_forest(rows, columns, learner(), counted=0), "rows": ensemble.fitted_forest(rows, columns, learner()), "seed": ensemble.fitted_forest(rows, columns, other)}
    trees = made["counts"].stages[-1].trees
    assert len(trees) == 25 and all(t.depth <= 4 for t in trees) and len({t.toDebugString.split("\n", 1)[1] for t in trees}) > 20
    told = ensemble.scored_by(rows, made).toPandas()
    assert (told["counts"] - told["rows"]).abs().mean() < 1.5 * (told["seed"] - told["rows"]).abs().mean() + 0.002
    gains = [importance.gains(m, columns) for m in made.values()]
    assert all(abs(gains[0][c] - gains[1][c]) < 0.03 for c in columns)


def test_draws_are_poisson_and_do_not_depend_on_partitions(spark):
    counts = spark.createDataFrame([(float(i), i % 2 * 1.0, 1 + 40 * (i % 3)) for i in range(900)], "a double, label double, n long")
    frames = [spark.read.parquet(forests.draws(x, 30, 5)).toPandas().sort_values(["t", "a"]) for x in (counts, counts.repartition(7))]
    assert frames[0].reset_index(drop=True).equals(frames[1].reset_index(drop=True)) and (frames[0]["w"] > 0).all()
    for n in (1, 41, 81):
        w = frames[0][(frames[0]["a"] % 3) == (n - 1) // 40]["w"].to_numpy()
        w = np.concatenate([w, np.zeros(9000 - len(w))])  # 300 rows, 30 trees
        assert abs(w.mean() - n) < 4 * (n / 9000) ** 0.5 and abs(w.var() / n - 1) < 0.1


def test_a_forest_is_asked_once_for_each_distinct_row(spark):
    rows = repeating(spark, 2000)
    model = ensemble.fitted(rows, ["x", "z", "u"], ensemble.forest(5, 3))
    said = forests.told(rows, model, lambda p: p / 2)
    by = model.stages[0]
    assert said.count() == by.transform(rows).select(*by.getOutputCols()).distinct().count() < 1700
    plain = {r["id"]: r["probability"][1] for r in model.transform(rows).select("id", "probability").collect()}
    got = {r["id"]: r["q"] for r in ensemble.scored_by(rows, {"q": model}, {"q": lambda p: p / 2}).collect()}
    assert got == {k: v / 2 for k, v in plain.items()}


def test_trees_part_bins_in_their_order(spark):
    """Bins aren't categories: only the halves of a sawtooth that lie together may be told apart by one cut."""
    rows = spark.range(4000).selectExpr("id", "double(id % 20) AS x", "double(id % 2) AS label")
    model = ensemble.fitted(stored(rows), ["x"], ensemble.forest(3, 1))
    assert " in {" not in "".join(t.toDebugString for t in model.stages[-1].trees)


def test_fits_side_by_side_hold_a_bounded_number_of_rows():
    assert [ensemble.beside(n) for n in (0, 1000, ensemble.HELD // 3, ensemble.HELD, 10 * ensemble.HELD)] == [4, 4, 3, 1, 1]


def test_importance_scores_each_distinct_copy_once(spark, monkeypatch):
    """Equal copies are counted before they are scored, with the result of scoring all of them."""
    rows, columns = repeating(spark, 1500), ["x", "z", "u"]
    model = ensemble.fitted(rows, columns, ensemble.forest(8, 3))
    asked = []
    real = importance.permuted
    monkeypatch.setattr(importance, "permuted", lambda rows, columns, predict, *rest, **how: real(rows, columns, lambda x: (asked.append((x.count(), x.distinct().count())), predict(x))[1], *rest, **how))
    got = {r["feature"]: r for r in importance.report(rows, columns, model, lambda x: ensemble.scored(x, model), "id", repeats=3).collect()}
    monkeypatch.undo()
    assert len(asked) == 1 and asked[0][0] == asked[0][1] < 1500  # of 15000 copies
    want = {r["feature"]: r for r in importance.permuted(rows, columns, lambda x: ensemble.scored(x, model), "id", repeats=3).collect()}
    for c in columns:
        assert [got[c][k] for k in ("auc", "loss", "spread")] == pytest.approx([want[c][k] for k in ("auc", "loss", "spread")], abs=1e-12)


def test_held_rows_are_not_dealt_again_by_each_fit(spark):
    rows = ensemble.held(spark.range(1000, numPartitions=2).withColumn("fold", F.col("id") % 5), per=100)
    part = rows.filter("fold <> 2")
    assert rows.storageLevel.useDisk and not rows.storageLevel.useMemory
    assert rows.rdd.getNumPartitions() == 10 and ensemble.spread(part, per=100) is part and part.count() == 800
    rows.unpersist()


def test_what_the_stack_learns_from_is_narrow(folded, small, monkeypatch):
    """Out-of-fold scores are stored without the features, and all learners are measured from one stored pass."""
    kept = []
    real = ensemble.stored
    monkeypatch.setattr(ensemble, "stored", lambda df: (kept.append(df.columns), real(df))[1])
    stack = ensemble.Stack.fit(folded, COLUMNS, ensemble.fold_models(folded, COLUMNS, ["logistic", "forest"]))
    assert ["id", "label", "p_logistic", "p_forest"] in kept
    kept.clear()
    got = ensemble.measured_by(stack.predict(folded), {"logistic": "p_logistic", "stack": "p"}).collect()
    assert len(got) == 2 and kept == [["id", "p_logistic", "p", "won"]]
