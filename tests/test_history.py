import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from linewright import fixed_values as fixed
from linewright.functions import trees
from linewright.operators import calibration, history, metrics, scoring
from linewright.plans import fitting
from linewright.sources import stores

CONFIG = history.WalkForward(min_train_size=10, test_size=4, min_residual_history=5, min_calibration_history=20, minimum_validation_sample=30)


def series(spark, n=180, version="v1", seed=1, ties=False):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        a, b = rnd.random() * 4, rnd.random()
        y = 20 + 3 * a - 2 * b + rnd.gauss(0, 2)
        line = 24.0 + rnd.choice([-1, 0, 0.5, 1])
        if ties:
            y, a, b = float(round(y)), 0.0, 0.0
        data.append((version, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", a, b, float(y), line, 1.9, 1.95))
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "model_version string, t string, a double, b double, y double, line double, over_odds double, under_odds double")
    return df.withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def test_config_bounds():
    for bad in ({"min_train_size": 1}, {"min_train_size": 5, "test_size": 0}, {"min_train_size": 5, "min_residual_history": 1}):
        with pytest.raises(ValueError):
            history.WalkForward(**bad)


def test_linear_walk_forward_is_exact_and_leaks_nothing(spark, small_blocks):
    line = spark.range(30).select(F.lit("v").alias("g"), F.col("id").alias("pos"), F.col("id").cast("double").alias("x"), (3 + 2 * F.col("id")).cast("double").alias("y"))
    got = history.walk_forward_linear(line, ["g"], ["x"], history.WalkForward(min_train_size=10)).orderBy("pos").collect()
    assert [r.prediction for r in got[:10]] == [None] * 10
    assert [r.prediction for r in got[10:]] == pytest.approx([3 + 2 * i for i in range(10, 30)], abs=1e-9)
    full = history.with_position(series(spark), ["model_version"], ["ts"])
    short = full.where("pos < 90")
    run = lambda df: {r.pos: r.prediction for r in history.walk_forward_linear(df, ["model_version"], ["a", "b"], CONFIG).collect()}
    late, early = run(full), run(short)
    assert all((late[p] is None and early[p] is None) or late[p] == pytest.approx(early[p], abs=1e-10) for p in early)


def test_estimator_walk_forward_agrees_with_the_baseline(spark):
    df = history.with_position(series(spark, 60), ["model_version"], ["ts"])
    config = history.WalkForward(min_train_size=20, test_size=20)
    base = {r.pos: r.prediction for r in history.walk_forward_linear(df, ["model_version"], ["a", "b"], config).collect()}
    other = {r.pos: r.prediction for r in history.walk_forward_estimator(df, ["a", "b"], config, LinearRegression(solver="normal")).collect()}
    assert base.keys() == other.keys() and sum(v is None for v in base.values()) == 20
    assert all(other[p] is None if v is None else other[p] == pytest.approx(v, abs=1e-6) for p, v in base.items())


def test_estimators_over_many_series(spark, monkeypatch):
    """Several series of unequal length at once equal each series on its own; one without enough rows is not predicted; a failing fit ends the job."""
    monkeypatch.setattr(history, "ROWS_PER_FIT_TASK", 16)
    sizes = {"a": 60, "b": 47, "c": 20, None: 41}
    parts = [history.with_position(series(spark, n, "s", seed=i), ["model_version"], ["ts"]).withColumn("model_version", F.lit(name)) for i, (name, n) in enumerate(sizes.items())]
    df = reduce(lambda x, y: x.unionByName(y), parts)
    config = history.WalkForward(min_train_size=20, test_size=11)
    out = history.walk_forward_estimators(df, ["model_version"], ["a", "b"], config, LinearRegression(solver="normal"), parallel=3)
    assert out.columns == [*df.columns, "fold", "prediction"]
    got = {(r.model_version, r.pos): (r.fold, r.prediction) for r in out.collect()}
    base = history.walk_forward_linear(df, ["model_version"], ["a", "b"], config).collect()
    assert len(got) == sum(sizes.values()) == len(base)
    for r in base:
        fold, prediction = got[r.model_version, r.pos]
        assert fold == r.fold and (prediction is None if r.prediction is None else prediction == pytest.approx(r.prediction, abs=1e-6))
    with pytest.raises(Exception, match="(?i)no_such_solver|solver"):
        history.walk_forward_estimators(df, ["model_version"], ["a", "b"], config, LinearRegression(solver="no_such_solver"))


def slow_trees(x, y, s, new):
    """Trees grown by trying every cut of every drawn column, node by node."""
    rng = np.random.default_rng(s.seed)
    value, out = np.full(len(y), y.mean()), np.full(len(new), y.mean())

    def grow(rows, rest, columns, depth):
        best = (1e-12, None, None)
        for j in columns if depth else ():
            for a, b in zip(*(lambda v: (v[:-1], v[1:]))(np.unique(x[:, j]))):
                left = [r for r in rows if x[r, j] <= (a + b) / 2]
                right = [r for r in rows if x[r, j] > (a + b) / 2]
                if min(len(left), len(right)) < s.least_rows:
                    continue
                score = lambda part: sum(rest[r] for r in part) ** 2 / (len(part) + s.penalty)
                gain = score(left) + score(right) - score(rows)
                if gain > best[0] + 1e-9:
                    best = gain, j, (a + b) / 2
        if best[1] is None:
            return s.rate * sum(rest[r] for r in rows) / (len(rows) + s.penalty)
        _, j, cut = best
        return j, cut, grow([r for r in rows if x[r, j] <= cut], rest, columns, depth - 1), grow([r for r in rows if x[r, j] > cut], rest, columns, depth - 1)

    def leaf(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(s.trees):
        rows = [r for r, u in enumerate(rng.random(len(y))) if u < s.row_share]
        columns = sorted(rng.permutation(x.shape[1])[: max(1, int(s.column_share * x.shape[1]))])
        tree = grow(rows, y - value, columns, s.depth)
        value = value + [leaf(tree, row) for row in x]
        out = out + [leaf(tree, row) for row in new]
    return out


@pytest.mark.parametrize("shares", [(1.0, 1.0), (0.8, 0.7)])
def test_trees_equal_slow_ones(shares):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(45, 3)), 1)
    y = x[:, 0] ** 2 - 2 * x[:, 1] + rng.normal(size=45) / 3
    s = trees.TreeSettings(trees=6, rate=0.3, depth=3, least_rows=3, row_share=shares[0], column_share=shares[1], seed=7)
    new = rng.normal(size=(30, 3))
    assert trees.BoostedTrees(s).fit(x, y).predict(new) == pytest.approx(slow_trees(x, y, s, new), abs=1e-9)


def test_walk_forward_trees(spark, monkeypatch):
    """Every fold of every series equals a fit of its own on the rows before; a long series goes to MLlib; no future row matters."""
    monkeypatch.setattr(history, "FOLDS_PER_TASK", 2)
    settings = fixed.BOOSTED_TREES | {"maxIter": 8, "stepSize": 0.2}
    df = history.with_position(series(spark, 70, "v1").unionByName(series(spark, 37, "v2", seed=8)).unionByName(series(spark, 12, "v3", seed=9)), ["model_version"], ["ts"])
    config = history.WalkForward(min_train_size=20, test_size=9)
    run = lambda rows, **more: {(r.model_version, r.pos): (r.fold, r.prediction) for r in history.walk_forward_trees(rows, ["model_version"], ["a", "b"], config, settings=settings, **more).collect()}
    got, rows = run(df), df.toPandas()
    assert len(got) == 119 and all((p is None) == (f < 0) for f, p in got.values())
    s = trees.TreeSettings(trees=8, rate=0.2, depth=4, least_rows=5, row_share=0.85, column_share=0.85, seed=42)
    for version, part in rows.groupby("model_version"):
        part = part.sort_values("pos")
        for fold in {f for (v, _), (f, _) in got.items() if v == version and f >= 0}:
            start = 20 + 9 * fold
            past, now = part[part.pos < start], part[(part.pos >= start) & (part.pos < start + 9)]
            want = trees.BoostedTrees(s).fit(past[["a", "b"]].to_numpy(), past["y"].to_numpy()).predict(now[["a", "b"]].to_numpy())
            assert [got[version, p][1] for p in now.pos] == pytest.approx(list(want), abs=1e-9)
    early = run(df.where("pos < 40"))
    assert all(early[k] == got[k] for k in early if early[k][0] < 2)
    mixed = run(df.where("model_version <> 'v3'"), most_rows=40)
    assert {k: v for k, v in mixed.items() if k[0] == "v2"} == {k: v for k, v in got.items() if k[0] == "v2"}
    errors = [(mixed["v1", r.pos][1] - r.y) ** 2 for r in rows[rows.model_version == "v1"].itertuples() if mixed["v1", r.pos][1] is not None]
    assert len(errors) == 50 and np.mean(errors) < rows[rows.model_version == "v1"].y.var()


def test_walk_forward_trees_of_summed_rows(spark, monkeypatch):
    """A long series of few feature vectors is fitted on sums, as on its rows when trees see all of them; MLlib is not asked."""
    monkeypatch.setattr(history, "walk_forward_estimators", lambda *a, **k: pytest.fail("a fit per fold"))
    monkeypatch.setattr(history, "FOLDS_PER_TASK", 2)
    df = history.with_position(series(spark, 150, "v1").unionByName(series(spark, 150, "v2", seed=8)), ["model_version"], ["ts"])
    df = df.withColumns({"a": F.col("pos") % 2, "b": F.when(F.col("pos") % 3 > 0, F.lit(1.0)), "y": F.col("y") + F.col("a") * 3})
    config = history.WalkForward(min_train_size=60, test_size=40)
    whole = fixed.BOOSTED_TREES | {"maxIter": 8, "stepSize": 0.2, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0"}
    run = lambda rows, settings, **more: {(r.model_version, r.pos): (r.fold, r.prediction) for r in history.walk_forward_trees(rows, ["model_version"], ["a", "b"], config, settings=settings, **more).collect()}
    monkeypatch.setattr("linewright.functions.trees.SLOTS", 4)
    monkeypatch.setattr(history, "SLOTS", 4)
    got, want = run(df, whole, most_rows=149), run(df, whole)
    assert set(got) == set(want) and len(got) == 300
    for k, (fold, prediction) in want.items():
        assert got[k] == (fold, prediction if prediction is None else pytest.approx(prediction, abs=1e-9))
    early = run(df.where("pos < 140"), whole, most_rows=139)
    assert all(early[k] == (got[k][0], got[k][1] if got[k][1] is None else pytest.approx(got[k][1], abs=1e-9)) for k in early)
    drawn = run(df, whole | {"subsamplingRate": 0.6}, most_rows=149)
    assert all((p is None) == (f < 0) for f, p in drawn.values())


def test_final_models_of_many_series(spark):
    df = history.with_position(series(spark, 40, "v1").unionByName(series(spark, 40, "v2", seed=8)), ["model_version"], ["ts"])
    models = history.final_models(df, "model_version", ["a", "b"], LinearRegression(solver="normal"))
    fits = {r.model_version: r.beta for r in history.fit_linear(df, ["model_version"], ["a", "b"]).collect()}
    assert set(models) == set(fits)
    for name, beta in fits.items():
        assert [models[name].intercept, *models[name].coefficients] == pytest.approx(list(beta), abs=1e-6)


def test_checks_find_breaks_and_faults(spark, small_blocks):
    df = spark.createDataFrame([("g", i, t) for i, t in enumerate([1, 2, 2, 5, 4, 6] + list(range(7, 107)))], "g string, pos long, t int")
    assert sorted(r.pos for r in history.chronology_breaks(df, ["g"], ["pos"], "t").collect()) == [2, 4]
    bad = spark.createDataFrame([("g", 1.0, 2.0, 1.0, 1.9, 1.9), ("g", float("nan"), 2.0, 1.0, 1.0, 1.9)], "g string, x double, y double, line double, over_odds double, under_odds double")
    r = history.training_faults(bad, ["g"], ["x"]).first()
    assert (r.n, r.not_finite, r.bad_odds, r.usable) == (2, 1, 1, False)
    with pytest.raises(ValueError, match="training.unusable"):
        history.require_usable(history.training_faults(bad, ["g"], ["x"]))


def test_earlier_and_smaller_equals_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100, 257):
        t, points = rng.integers(0, 40, n), rng.random(n) < 0.4
        got = history.earlier_and_smaller(t, points)
        for i in range(n):
            assert points[i] or got[i] == sum(points[j] and t[j] < t[i] for j in range(i))


@pytest.mark.parametrize("block_rows", [100_000, 50, 7])
@pytest.mark.parametrize("ties", [False, True])
def test_pricing_by_earlier_residuals_equals_pairs(spark, block_rows, ties):
    both = series(spark, 170, "hot", ties=ties).unionByName(series(spark, 40, "b", seed=9, ties=ties))
    predicted = history.walk_forward_linear(history.with_position(both, ["model_version"], ["ts"]), ["model_version"], ["a"], CONFIG)
    if ties:
        predicted = predicted.withColumn("prediction", F.round("prediction"))
    local = [r.asDict() for r in predicted.collect()]
    got = {(r.model_version, r.pos): r for r in history.priced_history(predicted, ["model_version"], CONFIG, block_rows=block_rows).collect()}
    seen = 0
    for r in local:
        if r["prediction"] is None or r["pos"] - 10 < 5 or r["y"] == r["line"]:
            assert (r["model_version"], r["pos"]) not in got
            continue
        past = [q["y"] - q["prediction"] for q in local if q["model_version"] == r["model_version"] and q["prediction"] is not None and q["pos"] < r["pos"]]
        cut = r["line"] - r["prediction"]
        over, under = sum(x > cut + 1e-12 for x in past), sum(x < cut - 1e-12 for x in past)
        row = got[(r["model_version"], r["pos"])]
        assert (row.over, row.under, row.residual_n) == (over / len(past), under / len(past), len(past))
        assert row.push == pytest.approx(1 - row.over - row.under, abs=1e-12)
        assert row.outcome == int(r["y"] > r["line"])
        seen += 1
    assert seen == len(got) > 100


def newton(x, y):
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + b * 1e-6])
        q = p * (1 - p)
        h = np.array([[q.sum(), (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return a, b


def labelled(n, seed=2, slope=0.8):
    rng = np.random.default_rng(seed)
    raw = rng.uniform(0.02, 0.98, n)
    x = np.log(raw / (1 - raw))
    return raw, x, (rng.random(n) < 1 / (1 + np.exp(-(0.2 + slope * x)))).astype(int)


@pytest.mark.parametrize("slope", [0.8, 8.0])
def test_platt_fit_matches_newton_and_mllib(spark, slope):
    raw, x, y = labelled(3000, slope=slope)
    df = spark.createDataFrame([("v", float(r), int(o)) for r, o in zip(raw, y)], "model_version string, raw double, outcome int")
    fit = calibration.platt_fit(df, ["model_version"]).first()
    a, b = newton(x, y)
    assert (fit.intercept, fit.coefficient) == pytest.approx((a, b), abs=1e-7)
    assert fit.training_sample_size == 3000 and fit.positive_rate == pytest.approx(y.mean())
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumn("x", F.ln(F.col("raw") / (1 - F.col("raw")))))
    model = LogisticRegression(labelCol="outcome", regParam=1 / (1e6 * 3000), elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=500).fit(ready)
    assert (model.intercept, model.coefficients[0]) == pytest.approx((fit.intercept, fit.coefficient), abs=1e-4)


@pytest.mark.parametrize("block_rows", [20_000, 400])
def test_walk_forward_platt_matches_a_fit_per_prefix(spark, block_rows):
    raw, x, y = labelled(1700)
    df = spark.createDataFrame([("v", i, float(r), int(o)) for i, (r, o) in enumerate(zip(raw, y))], "g string, pos long, raw double, outcome int")
    got = {r.pos: r.calibrated for r in calibration.walk_forward_platt(df, ["g"], ["pos"], minimum_history=30, block_rows=block_rows).collect()}
    assert sorted(got) == list(range(30, 1700))
    for i in [30, 31, 77, 399, 400, 401, 999, 1255, 1256, 1257, 1500, 1699]:
        a, b = newton(x[:i], y[:i])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(a + b * x[i]))), abs=1e-8)


def test_walk_forward_platt_skips_one_class(spark):
    df = spark.createDataFrame([("v", i, 0.4 + 0.01 * (i % 7), int(i >= 12)) for i in range(40)], "g string, pos long, raw double, outcome int")
    got = calibration.walk_forward_platt(df, ["g"], ["pos"], minimum_history=5).collect()
    assert min(r.pos for r in got) == 13


def test_steep_fits_are_refined(spark):
    raw, x, y = labelled(4000, slope=40.0)
    df = spark.createDataFrame([("v", i, float(r), int(o)) for i, (r, o) in enumerate(zip(raw, y))], "g string, pos long, raw double, outcome int")
    got = {r.pos: r.calibrated for r in calibration.walk_forward_platt(df, ["g"], ["pos"], minimum_history=3000).collect()}
    for i in (3000, 3500, 3999):
        fit = calibration.platt_fit(df.where(F.col("pos") < i), ["g"]).first()
        z = fit.intercept + fit.coefficient * x[i]
        assert fit.coefficient > 10
        assert got[i] == pytest.approx(min(max(1 / (1 + math.exp(-z)), 1e-6), 1 - 1e-6), abs=1e-7)


@pytest.mark.parametrize("block_rows", [10_000, 3])
def test_line_probability_with_push(spark, block_rows):
    residuals = spark.createDataFrame([("v", x) for x in (-2.0, 0.0, 1.0, 2.0)], "model_version string, residual double")
    asked = spark.createDataFrame([("v", 1, 10.0, 11.0), ("v", 2, 10.0, 100.0)], "model_version string, id int, prediction double, line double")
    got = {r.id: r for r in scoring.line_probability(asked, residuals, ["model_version"], "id", block_rows=block_rows).collect()}
    r = got[1]
    assert (r.threshold, r.over, r.under, r.push) == (1.0, 0.25, 0.5, 0.25) and r.raw == pytest.approx(1 / 3)
    assert (got[2].over, got[2].under) == (0.0, 1.0)
    cal = spark.createDataFrame([("v", 0.0, 1.0)], "model_version string, intercept double, coefficient double")
    scored = scoring.exact_line_scores(
        scoring.line_probability(asked, residuals, ["model_version"], "id").where("id = 1")
        .crossJoin(spark.createDataFrame([(" Over ", 1.9, 2.0), ("under", 2.0, 1.9)], "selection string, odds double, opposing_odds double")), cal, ["model_version"],
    ).collect()
    over, under = sorted(scored, key=lambda r: r.odds)
    assert over.selected_calibrated == pytest.approx(0.25) and under.selected_calibrated == pytest.approx(0.5)
    assert over.selected_calibrated + over.opposing_calibrated + over.push == pytest.approx(1)
    assert over.expected_value_with_push == pytest.approx(0.25 * 1.9 + 0.25 - 1)


def test_faulty_versions_are_report_rows(spark):
    sound = series(spark, 180, "sound")
    sure = series(spark, 180, "sure", seed=4).withColumn("y", F.col("line") + 1 + F.col("b"))
    short = series(spark, 8, "short", seed=5)
    fitted = fitting.fit_history(sound.unionByName(sure).unionByName(short), ["a", "b"], CONFIG, strict=False)
    faults = {r.model_version: r.fault for r in fitted.report.collect()}
    assert faults == {"sound": None, "sure": "calibration.one_class", "short": "history.no_test_rows"}
    assert {r.model_version for r in fitted.predictions.select("model_version").distinct().collect()} == {"sound"}


def test_rows_fitted_together_are_bounded_by_their_points():
    """An array of a fit holds about as many numbers on the finest intervals as on the first ones."""
    for points in (1, 12, 768, 12 * 512, 12 * 4096):
        assert 1 <= calibration._together(points) <= 256 and calibration._together(points) * points <= 1 << 18
    assert calibration._together(768) == 256


def test_only_steep_groups_are_refined(spark):
    flat, steep = labelled(2000, seed=3), labelled(2000, seed=4, slope=40.0)
    data = [(g, i, float(r), int(o)) for g, (raw, _, y) in (("flat", flat), ("steep", steep)) for i, (r, o) in enumerate(zip(raw, y))]
    df = spark.createDataFrame(data, "g string, pos long, raw double, outcome int")
    both = {r.g: r for r in calibration.platt_fit(df, ["g"]).collect()}
    assert both["flat"].converged and both["steep"].converged and both["steep"].coefficient > 10
    alone = calibration.platt_fit(df.where("g = 'flat'"), ["g"]).first()
    assert (both["flat"].intercept, both["flat"].coefficient) == pytest.approx((alone.intercept, alone.coefficient), abs=1e-12)
    walked = calibration.walk_forward_platt(df, ["g"], ["pos"], minimum_history=1900)
    got = {(r.g, r.pos): r for r in walked.collect()}
    assert len(got) == 200 and all(r.converged and r.calibrated is not None for r in got.values())


def test_value_blocks_below_are_counted_without_a_grid(spark):
    rng = np.random.default_rng(5)
    rows = [("a", int(rng.integers(0, 40)), int(rng.integers(0, 30)), int(rng.integers(0, 3))) for _ in range(600)] + [("b", 3, 1, 1), ("b", 3, 2, 0)]
    cut = spark.createDataFrame(rows, f"g string, {history.BLOCK} long, _pb long, _kind int")
    got = {(r.g, r[history.BLOCK], r._pb): r._whole for r in history._whole_blocks(cut, ["g"]).collect()}
    for g, block, pb, kind in rows:
        if kind != 1:
            assert got.get((g, block, pb), 0) == sum(h == g and b < block and p < pb and k == 1 for h, b, p, k in rows)


def test_scorecard_and_status(spark):
    raw, _, y = labelled(500)
    df = spark.createDataFrame([("s", float(p), 0.5, int(o)) for p, o in zip(raw, y)], "seg string, p double, m double, y int")
    card = metrics.calibration_status(metrics.scorecard(df, "p", "m", "y", ["seg"]), 200).first()
    assert card.model_brier_score == pytest.approx(np.mean((raw - y) ** 2)) and card.market_brier_score == pytest.approx(0.25)
    assert card.brier_skill_score == pytest.approx(1 - card.model_brier_score / 0.25) and card.calibration_status == "validated"
    edges = np.linspace(0, 1, 11)[1:-1]
    bins = np.minimum(np.digitize(raw, edges), 9)
    ece = sum(np.mean(bins == i) * abs(raw[bins == i].mean() - y[bins == i].mean()) for i in range(10) if (bins == i).any())
    assert card.model_ece == pytest.approx(ece)
    assert metrics.calibration_status(metrics.scorecard(df, "p", "m", "y"), 501).first().calibration_status == "provisional"
    assert metrics.calibration_status(metrics.scorecard(df, "m", "p", "y"), 10).first().calibration_status == "degraded"


def test_whole_fit_and_bundle(spark, folder):
    df = series(spark, 180, "v1").unionByName(series(spark, 180, "v2", seed=8))
    fitted = fitting.fit_history(df, ["a", "b"], CONFIG)
    report = {r.model_version: r for r in fitted.report.collect()}
    assert set(report) == {"v1", "v2"} and all(r.sample_size > 50 for r in report.values())
    assert report["v1"].calibration_status in ("validated", "degraded")
    assert report["v1"].validation_period_end <= report["v1"].training_cutoff_at
    assert fitted.residuals.count() == 2 * 170
    versions = {r.model_version: r.residual_distribution_version for r in fitted.residual_versions.collect()}
    assert versions["v1"].startswith("v1-residuals-") and versions["v1"][-12:] != versions["v2"][-12:]
    manifest = {r.name: r.content_sha256 for r in stores.write_bundle(fitting.bundle_tables(fitted), f"{folder}/v").collect()}
    assert set(manifest) == {"residuals", "residual_versions", "calibrators", "validation_report"}
    with pytest.raises(Exception, match="(?i)exists"):
        stores.write_bundle(fitting.bundle_tables(fitted), f"{folder}/v")
    broken = df.withColumn("ts", F.date_trunc("hour", "ts"))
    with pytest.raises(ValueError, match="chronology.not_increasing"):
        fitting.fit_history(broken, ["a"], CONFIG, order=("ts", "a"))
    with pytest.raises(ValueError, match="history.no_test_rows|history.too_few_priced"):
        fitting.fit_history(df.limit(16), ["a"], CONFIG)
