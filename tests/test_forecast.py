"""The forecast: boosting against a naive one, gaps, the linear model against numpy, and the stored stage."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from moodtide.operators import boosting, forecast, series
from moodtide.operators import examples as ex

DAY = dt.date(2020, 1, 1)
GRID = {"maxDepth": (1, 3), "maxIter": (2, 5), "stepSize": (0.3, 0.5)}


def naive_tree(x, gradient, depth, step):
    """One tree by trying every value of every feature with missing values on either side."""

    def build(rows, left_depth):
        total, n = gradient[rows].sum(), len(rows)
        best, chosen = 1e-9, None
        for f in range(x.shape[1] if left_depth and n > 1 else 0):
            column = x[rows, f]
            for threshold in np.unique(column[~np.isnan(column)]):
                for side in (False, True):
                    left = np.where(np.isnan(column), side, column <= threshold)
                    m = left.sum()
                    if 0 < m < n:
                        part = gradient[rows][left].sum()
                        gain = part**2 / (m + 1) + (total - part) ** 2 / (n - m + 1) - total**2 / (n + 1)
                        if gain > best + 1e-12:
                            best, chosen = gain, (f, threshold, side, left)
        if chosen is None:
            return -step * total / (n + 1)
        f, threshold, side, left = chosen
        return f, threshold, side, build(rows[left], left_depth - 1), build(rows[~left], left_depth - 1)

    return build(np.arange(len(gradient)), depth)


def value(tree, row):
    while isinstance(tree, tuple):
        f, threshold, side, left, right = tree
        tree = left if (side if np.isnan(row[f]) else row[f] <= threshold) else right
    return tree


@pytest.mark.parametrize("gaps", [0.0, 0.2])
@pytest.mark.parametrize("depth", [1, 3, 20])
def test_boosting_equals_a_naive_one(gaps, depth):
    rng = np.random.default_rng(depth)
    x = rng.normal(size=(40, 5))
    x[rng.random(x.shape) < gaps] = np.nan
    y = np.nan_to_num(x[:, 0]) ** 2 + rng.normal(size=40) * 0.1
    fitted = np.full(40, boosting.START)
    for tree in boosting.boost(x, y, depth, 0.3, 4):
        naive = naive_tree(x, fitted - y, depth, 0.3)
        expected = np.array([value(naive, row) for row in x])
        assert tree.predict(x) == pytest.approx(expected)
        fitted += expected


@pytest.mark.parametrize("high", [True, False])
def test_a_gap_learns_its_side(high):
    """Missing values behave like high ones, or like low ones."""
    x = np.array([[0.1], [0.2], [0.8], [0.9], [np.nan], [np.nan]])
    y = np.array([0.0, 0.0, 1.0, 1.0, float(high), float(high)])
    tree = next(boosting.boost(x, y, 1, 1.0, 1))
    assert tree.missing_left[0] != high
    assert tree.predict(np.array([[np.nan]]))[0] == tree.predict(np.array([[1.0 if high else 0.0]]))[0]


def test_wide_features_are_cut_at_quantiles():
    x = np.arange(10_000.0)[:, None]
    found = boosting.edges(x, 16)[0]
    assert len(found) == 16 and found[-1] == 9999 and abs(np.diff(found) - 625).max() <= 1


def daily(days=150, sources=("a", "b"), seed=1):
    draw, rows = random.Random(seed), []
    for s in sources:
        level = 50.0
        for i in range(days):
            level = 0.9 * level + 5 + draw.uniform(-3, 3)
            gap = i % 17 == 5
            rows.append((s, DAY + dt.timedelta(i), round(level, 3), None if gap else round(draw.uniform(0, 9), 3), None if i < 4 else i % 7))
    return rows


KINDS = "source string, date date, close double, metric double, posts int"


def test_search_scores_every_candidate_and_refits_the_best(spark):
    features = spark.createDataFrame(daily(), KINDS).repartition(5)
    flat, fit = forecast.prepared_examples(features, "close", ["metric", "posts"], window=4, test_rows=20)
    assert flat.where("split = 'train'").count() == 2 * (130 - 4)  # no row is left out
    found = forecast.train_forecasters(flat, GRID)
    scores = {(r.source, r.maxDepth, r.maxIter, r.stepSize): r.mean_score for r in found.scores.collect()}
    assert len(scores) == 2 * 8
    rows = [r for r in flat.orderBy("date").collect() if r.source == "a"]
    x, y = (np.array([r[c].toArray() if c == "features" else r[c] for r in rows if r.split == "train"]) for c in ("features", "y"))
    half = len(y) // 2 + len(y) % 2
    for depth, trees, step in ((1, 2, 0.3), (3, 5, 0.5)):
        each = []
        for inside, out in ((slice(half, None), slice(None, half)), (slice(None, half), slice(half, None))):
            predicted = boosting.START + sum(t.predict(x[out]) for t in boosting.boost(x[inside], y[inside], depth, step, trees))
            each.append(1 - ((predicted - y[out]) ** 2).mean() / y[out].var())
        assert scores["a", depth, trees, step] == pytest.approx(np.mean(each))
    chosen = {r.source: r for r in found.chosen.collect()}
    assert chosen["a"].mean_score == max(v for k, v in scores.items() if k[0] == "a")
    best = chosen["a"]
    test = np.array([r.features.toArray() for r in rows if r.split == "test"])
    expected = boosting.START + sum(t.predict(test) for t in boosting.boost(x, y, best.maxDepth, best.stepSize, best.maxIter))
    predicted = forecast.predict_forecast(found, flat, fit, "close").where("source = 'a'").orderBy("date").collect()
    assert [r.prediction_scaled for r in predicted] == pytest.approx(expected.tolist())
    assert [r.truth for r in predicted] == pytest.approx([r[2] for r in daily() if r[0] == "a"][-16:])


def test_series_in_batches_give_the_same(spark, monkeypatch):
    flat, _ = forecast.prepared_examples(spark.createDataFrame(daily(60, "abc"), KINDS), "close", ["posts"], window=3, test_rows=10, fill={"posts": 0})
    whole = forecast.train_forecasters(flat, GRID)
    monkeypatch.setattr(forecast, "MATRIX_BYTES", 4000)
    parts = forecast.train_forecasters(flat, GRID)
    order = ["source", "candidate"]
    assert whole.scores.orderBy(order).collect() == parts.scores.orderBy(order).collect()
    both = [sorted(m.transform(flat.where("split = 'test'")).select("source", "date", "prediction").collect()) for m in (whole, parts)]
    assert both[0] == both[1] and len(both[0]) == 3 * 7
    monkeypatch.setattr(forecast, "MATRIX_BYTES", 10)
    with pytest.raises(ValueError, match="train_by_levels"):
        forecast.train_forecasters(flat, GRID)
    assert forecast.train_by_levels(flat.where("source = 'a'"), 2, 3, 0.3).getNumTrees == 3


def test_linear_model_equals_numpy(spark):
    features = spark.createDataFrame(daily(), KINDS).repartition(3)
    flat, _ = forecast.prepared_examples(features, "close", ["metric"], window=4, test_rows=20, missing="ffill")
    found = forecast.train_linear(flat, penalties=(1e-6, 0.1))
    rows = [r for r in flat.where("source = 'b'").orderBy("date").collect()]
    x, y = (np.array([r[c].toArray() if c == "features" else r[c] for r in rows if r.split == "train"]) for c in ("features", "y"))

    def solve(x, y, penalty):
        z = np.column_stack([x, np.ones(len(x))])
        ridge = np.diag([penalty * len(x)] * x.shape[1] + [0.0])
        return np.linalg.solve(z.T @ z + ridge, z.T @ y)

    half = len(y) // 2 + len(y) % 2
    parts = (slice(None, half), slice(half, None))
    scores = {r.penalty: r.mean_score for r in found.scores.where("source = 'b'").collect()}
    for penalty, score in scores.items():
        each = [1 - ((np.column_stack([x[o], np.ones(len(x[o]))]) @ solve(x[i], y[i], penalty) - y[o]) ** 2).mean() / y[o].var() for o, i in (parts, parts[::-1])]
        assert score == pytest.approx(np.mean(each))
    penalty = max(scores, key=scores.get)
    test = np.array([r.features.toArray() for r in rows if r.split == "test"])
    expected = np.column_stack([test, np.ones(len(test))]) @ solve(x, y, penalty)
    predicted = found.transform(flat.where("split = 'test' and source = 'b'")).orderBy("date").collect()
    assert [r.prediction for r in predicted] == pytest.approx(expected.tolist())


@pytest.mark.parametrize("parts", [1, 16])
def test_carry_forward_equals_a_loop(spark, parts):
    draw, rows, expected = random.Random(3), [], []
    for s in ("hot", "thin", None):
        last, day = None, DAY
        for i in range(900 if s == "hot" else 40):
            day += dt.timedelta(1 if s == "hot" else draw.choice([1, 300, 700]))
            v = draw.choice([None, float("nan"), float(i)]) if draw.random() < 0.7 else None
            last = v if v is not None and v == v else last
            rows.append((s, day, v, 1))
            expected.append((s, day, last, 1))
    df = spark.createDataFrame(rows, "source string, date date, v double, other int").repartition(parts)
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in series.carry_forward(df, ["v"], ["source"]).collect()), key=key) == sorted(expected, key=key)


def test_gaps_are_kept_carried_or_dropped(spark):
    features = spark.createDataFrame(daily(40, "a"), KINDS)
    counts = {m: forecast.filled_features(features, "close", ["metric", "posts"], missing=m).count() for m in ("keep", "ffill", "drop")}
    assert counts == {"keep": 40, "ffill": 36, "drop": 40 - 4 - 3}
    with pytest.raises(ValueError, match="keep, ffill or drop"):
        forecast.filled_features(features, "close", [], missing="zero")


@pytest.mark.parametrize("kind", ["boosted", "linear"])
def test_a_stored_pipeline_forecasts_from_raw_features(spark, tmp_path, kind):
    features = spark.createDataFrame(daily(80, "ab"), KINDS)
    stage = forecast.Forecast("close", ["metric", "posts"], {"posts": 0}, window=4, testRows=20, kind=kind, grid=GRID)
    fitted = Pipeline(stages=[stage]).fit(features)
    fitted.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert loaded.stages[0].getOrDefault("target") == "close"
    raw = features.drop("split")
    pairs = [m.transform(raw).orderBy("source", "date").collect() for m in (fitted, loaded)]
    assert pairs[0] == pairs[1] and len(pairs[0]) >= 2 * 70
    assert {(r.source, r.date): r.truth for r in pairs[0]}["a", DAY + dt.timedelta(79)] == pytest.approx(daily(80, "ab")[79][2])
    flat, fit = forecast.prepared_examples(features, "close", ["metric", "posts"], 4, 20, {"posts": 0}, "keep" if kind == "boosted" else "ffill")
    model = forecast.train_forecasters(flat, GRID) if kind == "boosted" else forecast.train_linear(flat)
    tested = {(r.source, r.date): r.prediction for r in forecast.predict_forecast(model, flat, fit, "close").collect()}
    found = {(r.source, r.date): r.prediction for r in pairs[1]}
    assert len(tested) == 32 and all(found[k] == pytest.approx(v) for k, v in tested.items())


def test_experiments_cover_models_targets_and_runs(spark):
    features = spark.createDataFrame(daily(110, "ab"), KINDS).withColumn("log_price", F.ln("close"))
    found = forecast.experiment_matrix(features, ["close", "log_price"], ["posts"], runs=3, grid=GRID, fill={"posts": 0}).collect()
    assert len(found) == 2 * 2 * 2 * 3 and {(r.model, r.run) for r in found} == {(m, i) for m in ("boosted", "linear") for i in range(3)}
    assert all(r.rmse > 0 and r.rmse_scaled > 0 for r in found)


def test_flat_values_keep_gaps_as_nan(spark):
    rows = spark.createDataFrame([([(1.0, None)],)], "x array<struct<f1: double, f2: double>>")
    values = rows.select(ex.flat_values(F.col("x"), 2).alias("v")).head().v
    assert values[0] == 1.0 and values[1] != values[1]
