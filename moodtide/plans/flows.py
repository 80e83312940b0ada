"""The work of the engine from end to end: posts or chat messages to daily features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.functions import scores
from moodtide.operators import clean, daily, learn, lexicon

#: Share of the classifier in the blend, per kind of source.
POST_MODEL_SHARE = 0.3
CHAT_MODEL_SHARE = 0.4

#: What daily features need of a post besides its scores; text is left behind after scoring.
CARRIED = ("date", "has_title", "score", "num_comments", "upvote_ratio")


def score_posts(
    posts: DataFrame,
    terms: DataFrame,
    model_share: float = 0.0,
    load_model: Callable[[], Callable] | PipelineModel | None = None,
    scorer: Callable[..., DataFrame] = lexicon.lexicon_compound_emphasis,
    limit: int | None = 500,
    markers: Sequence[str] = clean.REMOVED_MARKERS,
    keep_text: bool = False,
) -> DataFrame:
    """Clean posts with ``sia_bert``, ``sia_vader`` and the weighted ``sia``.

    Posts have a ``date``. ``load_model`` is a classifier that Spark has fitted, whose scoring stays inside the
    query, or the loader of a foreign one. Texts are left behind unless ``keep_text`` is set, which joins the
    lexicon score to all columns and so moves the texts once.
    """
    cleaned = clean.drop_marked(clean.cast_defaults(clean.fill_text_nulls(posts)), markers)
    cleaned = clean.build_text(clean.drop_missing_time(cleaned, "date"), limit)
    scored = cleaned.withColumn("has_title", F.col("title") != "")
    carry = None if keep_text else list(CARRIED)
    if not keep_text:
        scored = scored.select("source", "id", *CARRIED, "text")
    if model_share >= scores.MIN_SHARE:
        if isinstance(load_model, PipelineModel):
            scored = learn.classifier_probability(load_model, scored, out="sia_bert")
        else:
            scored = learn.score_with_model(scored, load_model, out="sia_bert")
        scored = scored.withColumn("sia_bert", scores.rescale_unit(F.col("sia_bert")))
        carry = carry and [*carry, "sia_bert"]
    if 1.0 - model_share >= scores.MIN_SHARE:
        scored = scorer(scored, terms, carry=carry)
    return daily.add_blend(scored if keep_text else scored.drop("text"), model_share)


def daily_features(scored: DataFrame, indicators: DataFrame) -> DataFrame:
    """Daily sums of scored posts beside the market metrics of their day."""
    return daily.join_indicators(daily.daily_sentiment(scored, F.col("has_title")), indicators)


def chat_posts(messages: DataFrame) -> DataFrame:
    """Chat messages in the shape of posts."""
    return clean.unify_source(clean.iso_to_date(clean.flatten_messages(messages)))
