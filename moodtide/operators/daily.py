"""Daily sentiment features and their joins with market tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.functions import scores

#: Columns both the metrics table and the computed price indicators may have.
COMPUTED_INDICATORS = ("macd", "signal", "ema", "rsi", "volume")


def add_blend(df: DataFrame, model_share: float) -> DataFrame:
    """Add ``sia``: the engagement-weighted blend of ``sia_bert`` and ``sia_vader``.

    A score column that was not computed, because its share is below 0.1, is added as 0.
    """
    for c in ("sia_bert", "sia_vader"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    columns = [F.col(c) for c in ("sia_bert", "sia_vader", "score", "num_comments", "upvote_ratio")]
    return df.withColumn("sia", scores.blend_sentiment(model_share, *columns))


def daily_sentiment(df: DataFrame, has_title: Column | None = None) -> DataFrame:
    """Score sums, posts with a title and comments per source and day."""
    counted = has_title if has_title is not None else F.coalesce(F.col("title") != "", F.lit(False))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.nanvl(c, F.lit(None))), F.lit(0.0))

    return (
        df.where(F.col("date").isNotNull())
        .groupBy("source", "date")
        .agg(
            total("sia_bert").alias("sia_bert_sum"),
            total("sia_vader").alias("sia_vader_sum"),
            total("sia").alias("sia_sum"),
            F.count_if(counted).alias("num_posts"),
            F.sum(F.coalesce("num_comments", F.lit(0)).cast("bigint")).alias("num_comments"),
        )
    )


def join_indicators(daily: DataFrame, indicators: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Daily features with the market metrics of their day; a day without metrics keeps nulls.

    ``log_price`` is carried along. Both sides hold one row per day, so adaptive execution
    broadcasts the metrics whenever they are small.
    """
    metrics = indicators.drop(*drop)
    if "log_price" not in metrics.columns and "closing_price" in metrics.columns:
        metrics = metrics.withColumn("log_price", scores.log_price(F.col("closing_price")))
    return daily.join(metrics, "date", "left")


def join_prices(df: DataFrame, prices: DataFrame, series: str | None = None) -> DataFrame:
    """Features with the prices and computed indicators of their day.

    Where both sides have a column, the computed one replaces the other. Features with a ``series_id`` meet the prices of their own
    series. Others meet those of ``series``, which need not be named while ``prices`` holds one series alone; more of them
    are an error then, since every row would be doubled.
    """
    computed = [c for c in prices.columns if c not in ("date", "series_id")]
    kept = df.drop(*[c for c in df.columns if c in computed])
    if "series_id" in df.columns and "series_id" in prices.columns:
        return kept.join(prices.select("series_id", "date", *computed), ["series_id", "date"], "left")
    if series is not None:
        prices = prices.where(F.col("series_id") == series)
    elif "series_id" in prices.columns:
        found = [r["series_id"] for r in prices.select("series_id").distinct().limit(2).collect()]
        if len(found) > 1:
            raise ValueError(f"prices hold several series, such as {found}: name one, or give the features a series_id")
    return kept.join(prices.select("date", *computed), "date", "left")
