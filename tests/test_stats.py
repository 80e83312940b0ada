import math

import pytest
from pyspark.sql import functions as F

from moodtide.operators import encode, stats
from moodtide.session import with_global_position


def test_batch_metrics_counts_the_short_batch_in_full(spark):
    rows = [(i, 2.0, 1) for i in range(32)] + [(32, 2.0, 0)]
    found = stats.batch_metrics(spark.createDataFrame(rows, "i int, logit double, label int").repartition(5), ["i"]).head()
    right, wrong = math.log1p(math.exp(-2.0)), math.log1p(math.exp(2.0))
    assert (found.accuracy, found.batches) == (0.5, 2)
    assert found.loss == pytest.approx(right + wrong)


def test_loss_does_not_overflow(spark):
    rows = spark.createDataFrame([(0, 900.0, 0), (1, -900.0, 1)], "i int, logit double, label int")
    assert stats.batch_metrics(rows, ["i"], batch_size=2).head().loss == pytest.approx(900.0)


def test_global_position(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(9)
    assert all(r.k == r.position for r in with_global_position(rows, ["k"]).collect())


def test_correlation(spark):
    rows = [(float(i), float(-2 * i), 1.0, None if i % 3 else float(i * i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = {(r.feature_a, r.feature_b): r["corr"] for r in stats.correlation_matrix(frame, ["a", "b", "c", "d"]).collect()}
    assert len(found) == 6 and found["b", "a"] == pytest.approx(-1.0)
    assert found["c", "a"] is None and found["d", "c"] is None
    pairs = [(a, d) for a, _, _, d in rows if d is not None]
    ma, md = (sum(p[k] for p in pairs) / len(pairs) for k in (0, 1))
    cov = sum((a - ma) * (d - md) for a, d in pairs)
    expected = cov / math.sqrt(sum((a - ma) ** 2 for a, _ in pairs) * sum((d - md) ** 2 for _, d in pairs))
    assert found["d", "a"] == pytest.approx(expected)


def test_histogram_counts_outliers_apart_and_leaves_out_nan(spark):
    values = [(v,) for v in (float("nan"), 0.1, 5.0, -3.0, 1.0, -1.0, None, float("inf"))]
    rows = stats.score_histogram(spark.createDataFrame(values, "v double"), ["v"], bins=4).collect()
    assert {r.bin: (r.n, r.lower, r.upper) for r in rows} == {0: (1, None, -1.0), 1: (1, -1.0, -0.5), 3: (1, 0.0, 0.5), 4: (1, 0.5, 1.0), 5: (2, 1.0, None)}


def test_correlation_skips_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("nan"), 1.0), (3.0, 6.0)], "a double, b double")
    assert stats.correlation_matrix(df, ["a", "b"]).head()["corr"] == pytest.approx(1.0)


def test_density_equals_the_exact_kernel_sum(spark):
    import math
    import random

    rng = random.Random(1)
    values = [max(-1.0, min(1.0, rng.gauss(0.1, 0.3))) for _ in range(3000)]
    found = stats.score_density(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).collect()
    mean = sum(values) / len(values)
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) * len(values) ** -0.2
    for r in found[::10]:
        exact = sum(math.exp(-(((r.x - v) / h) ** 2) / 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(exact, abs=1e-9) and r.bound < 1e-9


@pytest.mark.parametrize("bins", [4, 8, 16])
def test_density_keeps_its_bound_with_wide_bins_and_values_outside(spark, bins):
    import math
    import random

    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0.0, 0.4), rng.uniform(-3, 3)]) for _ in range(500)] + [float("nan"), None, float("inf")]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    finite = [v for v in values if v is not None and abs(v) < math.inf]
    h = 0.3
    for r in stats.score_density(frame, ["v"], bins=bins, points=21, bandwidth=h).collect():
        exact = sum(math.exp(-(((r.x - v) / h) ** 2) / 2) for v in finite) / (len(finite) * h * math.sqrt(2 * math.pi))
        assert abs(r.density - exact) <= r.bound


def test_auto_histogram(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = rng.normal(size=2000)
    rows = [(float(v), 1.0) for v in values] + [(None, 1.0), (float("nan"), 1.0)]
    found = stats.auto_histogram(spark.createDataFrame(rows, "v double, same double").repartition(7), ["v", "same"]).collect()
    ordered = np.sort(values)
    step = 2 * (ordered[1499] - ordered[499]) / 2000 ** (1 / 3)
    bins = min(50, int(np.ceil((ordered[-1] - ordered[0]) / step)))
    counts, edges = np.histogram(values, bins)
    got = {r.bin: r for r in found if r.metric == "v"}
    assert {b: r.n for b, r in got.items()} == {i + 1: n for i, n in enumerate(counts.tolist()) if n}
    assert all(r.lower == pytest.approx(edges[b - 1]) and r.upper == pytest.approx(edges[b]) for b, r in got.items())
    assert [(r.bin, r.n, r.lower, r.upper) for r in found if r.metric == "same"] == [(1, 2002, 1.0, 1.0)]


def test_heavy_hitters_are_exact_or_refused(spark):
    import random
    from collections import Counter

    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(60_000)]
    frame = spark.createDataFrame([(" ".join(words[i : i + 50]),) for i in range(0, len(words), 50)], "text string").repartition(6)
    expected = sorted(Counter(words).items(), key=lambda r: (-r[1], r[0]))[:30]
    none = spark.createDataFrame([], "term string")
    for tracked in (1 << 17, 4096, 64):
        assert [tuple(r) for r in stats.word_frequency(frame, 30, none, tracked=tracked).collect()] == expected
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    likely = stats.heavy_hitters(terms, 30, 1 << 14)
    assert 30 <= likely.count() <= 120 and {r.term for r in likely.collect()} >= {w for w, _ in expected}
    assert stats.heavy_hitters(spark.createDataFrame([(f"v{i}",) for i in range(5000)], "term string"), 30, 512) is None
    assert stats.heavy_hitters(terms.where("false"), 30).count() == 0


def test_density_integrates_to_one(spark):
    rows = spark.range(400).select((F.sin("id") / 3).alias("v"))
    found = stats.score_density(rows, ["v"], points=201).collect()
    assert sum(r.density for r in found) * 0.01 == pytest.approx(1.0, abs=0.02)
    constant = stats.score_density(spark.createDataFrame([(0.5,), (0.5,)], "v double"), ["v"]).collect()
    assert all(r.density is None for r in constant)


def test_select_best_takes_the_earliest_tie(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, None)], "epoch int, accuracy double")
    assert tuple(stats.select_best(rows, "accuracy", "epoch").head()) == (1, 0.9)


def test_words(spark):
    rows = spark.createDataFrame([("The cat's cat, the DOG a",), ("dog cat",), (None,)], "text string")
    assert [tuple(r) for r in stats.word_frequency(rows, 2).collect()] == [("cat", 2), ("dog", 2)]
    stop = spark.createDataFrame([("cat",)], "term string")
    found = {r.term: r.n for r in stats.word_frequency(rows, 10, stop).collect()}
    assert found == {"the": 2, "cat's": 1, "dog": 2}


def test_rmse(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "truth double, prediction double")
    assert stats.rmse(rows).head().rmse == pytest.approx(math.sqrt(0.5))


def test_vocabulary_and_sequences(spark):
    texts = ["a b", "a b c d e f g h i", "", None, "a zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vocab = encode.build_vocab(rows.where("id < 2"))
    ids = {r.term: r.token_id for r in vocab.collect()}
    assert [ids[t] for t in "abcdefghi"] == list(range(4, 13))
    top = encode.build_vocab(rows.where("id < 2"), size=3)
    assert sorted(tuple(r) for r in top.collect()) == sorted(tuple(r) for r in vocab.where("token_id < 7").collect())
    found = {r.id: r for r in encode.encode_sequence(rows, vocab, 6).collect()}
    assert found[0].input_ids == [2, 4, 5, 3, 0, 0] and found[0].attention_mask == [1, 1, 1, 1, 0, 0]
    assert found[1].input_ids == [2, 4, 5, 6, 7, 3] and found[1].attention_mask == [1] * 6
    assert found[2].input_ids == found[3].input_ids == [2, 3, 0, 0, 0, 0]
    assert found[4].input_ids == [2, 4, 1, 3, 0, 0]
