import pytest
from pyspark.sql import functions as F

from moodtide.functions import scores


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    "sentiment, comments, score, ratio, expected",
    [
        (0.5, 0, 1, 1.0, 0.26248959373947),
        (0.5, 10, 20, 0.8, 0.29758978494589183),
        (-0.4, 3, 5, 0.25, 0.18734382112768416),
    ],
)
def test_engagement_weight(spark, sentiment, comments, score, ratio, expected):
    weighted = scores.engagement_weight(F.lit(sentiment), F.lit(score), F.lit(comments), F.lit(ratio))
    assert value(spark, weighted) == pytest.approx(expected, abs=1e-14)
    opposite = scores.engagement_weight(F.lit(-sentiment), F.lit(score), F.lit(comments), F.lit(ratio))
    assert value(spark, opposite) == pytest.approx(-expected, abs=1e-14)


def test_zero_ratio_gives_null(spark):
    assert value(spark, scores.engagement_weight(F.lit(0.5), F.lit(1), F.lit(0), F.lit(0.0))) is None


def test_blend(spark):
    blended = scores.blend_sentiment(0.3, F.lit(0.2), F.lit(0.5), F.lit(20), F.lit(10), F.lit(0.8))
    assert value(spark, blended) == pytest.approx(0.2440236236556313, abs=1e-14)


def test_blend_leaves_out_a_small_share(spark):
    columns = [F.lit(1), F.lit(0), F.lit(1.0)]
    alone = scores.blend_sentiment(0.05, F.lit(None).cast("double"), F.lit(0.5), *columns)
    assert value(spark, alone) == pytest.approx(0.95 * 0.52497918747894 * 0.5)


@pytest.mark.parametrize("total, expected", [(0.5, 0.12803687993289598), (-0.8, -0.20228869496966945), (3.1, 0.6248933269389457), (0.0, 0.0)])
def test_compound(spark, total, expected):
    assert value(spark, scores.compound(F.lit(total))) == pytest.approx(expected, abs=1e-15)


@pytest.mark.parametrize("p, expected", [(0.5, ("Negative", 50)), (0.995, ("Positive", 99)), (0.01, ("Negative", 99))])
def test_classify(spark, p, expected):
    row = spark.range(1).select(scores.classify_sentiment(F.lit(p)).alias("s"), scores.classify_percentage(F.lit(p)).alias("n")).head()
    assert tuple(row) == expected


def test_sigmoid_does_not_overflow(spark):
    assert value(spark, scores.sigmoid(F.lit(-800.0))) == 0.0
    assert value(spark, scores.sigmoid(F.lit(800.0))) == 1.0


def test_log_price(spark):
    assert value(spark, scores.log_price(F.lit(0.0))) is None
    assert value(spark, scores.log_price(F.lit(1.0))) == 0.0


def test_ensemble_and_rescale(spark):
    assert value(spark, scores.ensemble_mean([F.lit(0.2), F.lit(0.4), F.lit(0.9)])) == pytest.approx(0.5)
    assert value(spark, scores.rescale_unit(F.lit(0.25))) == -0.5
