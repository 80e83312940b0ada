import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from moodtide.operators import examples as ex
from moodtide.operators import series

START = dt.date(2000, 1, 1)
GOLDEN = {
    "ema": [10, 10.555555556, 11.147540984, 11.097560976, 11.663493574],
    "macd": [0, 0.022435897, 0.059597727, 0.038934447, 0.106471265],
    "signal": [0, 0.012464387, 0.03178133, 0.034204473, 0.055702209],
    "rsi": [None, 100, 100, 64.168190128, 79.776172712],
}


def naive(values, alpha):
    num = den = 0.0
    for v in values:
        num, den = num * (1 - alpha) + (v or 0.0), den * (1 - alpha) + (v is not None)
        yield num / den if den else None


def walk(n, seed, gaps):
    draw, day, price, rows = random.Random(seed), START, 100.0, []
    for i in range(n):
        price *= 1 + draw.uniform(-0.05, 0.05)
        rows.append((day, None if gaps and draw.random() < 0.1 else round(price, 2)))
        day += dt.timedelta(days=1 if not gaps else draw.choice([1, 1, 2, 400]))
    return rows


def test_golden_indicators_across_blocks(spark):
    closes = [10.0, 11.0, 12.0, 11.0, 13.0]
    rows = [("p", START + dt.timedelta(days=200 * i), c, 1.0) for i, c in enumerate(closes)]
    found = series.price_indicators(spark.createDataFrame(rows, "series_id string, date date, close double, volume double")).orderBy("date").collect()
    for name, expected in GOLDEN.items():
        assert [r[name] for r in found] == [None if e is None else pytest.approx(e, abs=1e-9) for e in expected]
    single = {"ema": series.ema, "macd": series.macd, "rsi": series.rsi}
    for name, operator in single.items():
        prices = spark.createDataFrame(rows, "series_id string, date date, close double, volume double")
        assert [r[name] for r in operator(prices).orderBy("date").collect()] == [r[name] for r in found]


@pytest.mark.parametrize("alpha", [0.2, 2 / 27, 1 / 14, 0.9])
def test_block_scan_equals_fold(spark, alpha):
    data = {"hot": walk(1500, 1, False), "gappy": walk(120, 2, True), "one": walk(1, 3, False), "empty": [(START, None), (START + dt.timedelta(300), None)]}
    rows = [(k, d, v) for k, points in data.items() for d, v in points]
    frame = spark.createDataFrame(rows, "series_id string, date date, x double").repartition(7)
    found = series.ewm_means(frame, [series.Ewm("x", alpha, "m")], previous={"x": "before"}).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.series_id, r.date)):
        by.setdefault(r.series_id, []).append(r)
    for k, points in data.items():
        values = [v for _, v in points]
        expected = list(naive(values, alpha))
        assert [r.m for r in by[k]] == [None if e is None else pytest.approx(e, rel=1e-12) for e in expected]
        assert [r.before for r in by[k]] == [None, *values[:-1]]


def test_alpha_must_be_a_fraction():
    with pytest.raises(ValueError):
        series.Ewm("x", 1.0, "m")


def frame(spark, n, source="s", gap=1):
    rows = [(source, START + dt.timedelta(days=gap * i), float(i), float(i % 7)) for i in range(n)]
    return spark.createDataFrame(rows, "source string, date date, y double, z double")


def test_position(spark):
    both = frame(spark, 700, gap=3).unionByName(frame(spark, 5, "t", 300))
    found = series.with_series_position(both, ["source"]).collect()
    assert all(r._pos == int(r.y) and r._len == (700 if r.source == "s" else 5) for r in found)


def test_split_then_windows(spark):
    split = ex.chronological_split(frame(spark, 100))
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 40, "test": 60}
    found = ex.sliding_examples(split, "y", ["z"])
    assert {r.split: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 10, "test": 30}
    first = found.where("split = 'train'").orderBy("date").head()
    assert first.y == 30.0 and [r.f1 for r in first.x] == [float(i) for i in range(30)]


@pytest.mark.parametrize("window", [1, 30, 255, 256, 300])
def test_windows_over_run_borders(spark, window):
    found = ex.sliding_examples(frame(spark, 900, gap=9), "y", ["z"], window, keys=("source",)).collect()
    assert len(found) == 900 - window
    for r in found:
        assert [x.f1 for x in r.x] == [float(i) for i in range(int(r.y) - window, int(r.y))]


def test_windows_keep_nulls_in_place(spark):
    rows = frame(spark, 40).withColumn("z", F.when(F.col("y") % 2 == 0, F.col("z")))
    first = ex.sliding_examples(rows, "y", ["z"], 30, keys=("source",)).orderBy("date").head()
    assert [x.f2 is None for x in first.x] == [i % 2 == 1 for i in range(30)]


def test_scaling_round_trip(spark):
    split = ex.chronological_split(frame(spark, 100).withColumn("c", F.lit(5.0)))
    columns = ["y", "z", "c"]
    fit = ex.fit_min_max(split, columns)
    assert (fit.head().y_min, fit.head().y_max) == (0.0, 39.0)
    scaled = ex.scale_min_max(split, fit, columns)
    assert scaled.agg(F.max("y")).head()[0] == pytest.approx(99 / 39)
    assert scaled.agg(F.max("c")).head()[0] == 0.0
    back = ex.inverse_scale(scaled, fit, "y", ["y"]).orderBy("date").collect()
    assert [r.y for r in back] == [pytest.approx(float(i)) for i in range(100)]


def test_flatten(spark):
    flat = ex.flatten_examples(ex.sliding_examples(frame(spark, 5), "y", ["z"], 2, keys=("source",)), 2)
    assert list(flat.orderBy("date").head().features) == [0.0, 0.0, 1.0, 1.0]


def test_tail(spark):
    both = frame(spark, 50).unionByName(frame(spark, 3, "t"))
    found = ex.tail_n(both, 10)
    assert sorted(r.y for r in found.where("source = 's'").collect()) == [float(i) for i in range(40, 50)]
    assert found.where("source = 't'").count() == 3
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_a_source_without_training_rows_keeps_its_rows(spark):
    long, short = frame(spark, 90, "long"), frame(spark, 50, "short")
    split = ex.chronological_split(long.unionByName(short))
    fit = ex.fit_min_max(split, ["y"])
    scaled = ex.scale_min_max(split, fit, ["y"])
    assert {r.source: r["count"] for r in scaled.groupBy("source").count().collect()} == {"long": 90, "short": 50}
    assert scaled.where("source = 'short' and y is not null").count() == 0
    assert ex.inverse_scale(scaled, fit, "y", ["y"]).count() == 140
