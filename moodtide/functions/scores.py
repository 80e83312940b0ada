"""Scalar score arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments count this many votes each, and popularity is damped by ten.
VOTES_PER_COMMENT = 2.316
POPULARITY_DAMPING = 10.0
#: A scorer whose share of the blend is below this is not run at all.
MIN_SHARE = 0.1


def rescale_unit(c: Column) -> Column:
    """Map [0, 1] onto [-1, 1]."""
    return c * F.lit(2.0) - F.lit(1.0)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def ensemble_mean(scores: Sequence[Column]) -> Column:
    """Plain mean of several scores; null when any of them is null."""
    total = scores[0]
    for score in scores[1:]:
        total = total + score
    return total / F.lit(float(len(scores)))


def engagement_weight(sentiment: Column, score: Column, num_comments: Column, upvote_ratio: Column) -> Column:
    """Sentiment times popularity times agreement; null when the ratio is 0."""
    ratio = upvote_ratio.cast("double")
    votes = F.try_divide(score.cast("double"), ratio)
    popularity = sigmoid((votes + num_comments.cast("double") * VOTES_PER_COMMENT) / POPULARITY_DAMPING)
    return popularity * rescale_unit(ratio) * sentiment


def blend_sentiment(
    model_share: float,
    model_score: Column,
    lexicon_score: Column,
    score: Column,
    num_comments: Column,
    upvote_ratio: Column,
) -> Column:
    """Weighted sum of both engagement-weighted scores; a share below 0.1 leaves its scorer out."""
    parts = [
        F.lit(share) * engagement_weight(sentiment, score, num_comments, upvote_ratio)
        for share, sentiment in ((model_share, model_score), (1.0 - model_share, lexicon_score))
        if share >= MIN_SHARE
    ]
    return parts[0] if len(parts) == 1 else parts[0] + parts[1]


def positive_label(p: Column) -> Column:
    """1 when the probability is above one half, else 0."""
    return (p > 0.5).cast("int")


def classify_sentiment(p: Column) -> Column:
    return F.when(p > 0.5, F.lit("Positive")).when(p.isNotNull(), F.lit("Negative"))


def classify_percentage(p: Column) -> Column:
    """Certainty of the chosen label in whole percent, cut and not rounded."""
    percent = p * 100.0
    return F.when(p > 0.5, percent).otherwise(F.lit(100.0) - percent).cast("int")


def accuracy_flag(p: Column, label: Column) -> Column:
    return positive_label(p) == label


def log_price(price: Column) -> Column:
    """Natural logarithm; null for a price that is not positive."""
    return F.when(price > 0, F.ln(price))


def compound(total: Column) -> Column:
    """Squash a polarity total into [-1, 1]."""
    squashed = total / F.sqrt(total * total + F.lit(15.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), squashed))


def binary_cross_entropy(logit: Column, label: Column) -> Column:
    """Loss of a logit against a 0/1 label, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
