"""Queries: series indicators, splits, scaling and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions import scores
from moodtide.operators import examples as ex
from moodtide.operators import series, stats
from moodtide.plans import fixtures as fx
from moodtide.plans.registry import query
from moodtide.plans.series_sql import INDICATED_CTE, SPLIT_CTE

COLUMNS = ("close", "high", "volume")


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return fx.prices(spark, sf).select("series_id", "date", "close", "volume")


@query("log_price", f"with {fx.PRICES_CTE} select date, case when close > 0 then round(ln(close), 6) end as log_price from prices")
def log_price(spark: SparkSession, sf: str) -> DataFrame:
    return fx.prices(spark, sf).select("date", F.round(scores.log_price(F.col("close")), 6).alias("log_price"))


@query("ema", f"with {INDICATED_CTE} select series_id, date, round(ema, 3) as ema from indicated")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return series.ema(_prices(spark, sf)).select("series_id", "date", F.round("ema", 3).alias("ema"))


@query(
    "macd",
    f"with {INDICATED_CTE} select series_id, date, round(macd, 3) + 0.0 as macd, round(signal, 3) + 0.0 as signal from indicated",
)
def macd(spark: SparkSession, sf: str) -> DataFrame:
    line = series.macd(_prices(spark, sf))
    return line.select("series_id", "date", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("macd", "signal")])


@query("rsi", f"with {INDICATED_CTE} select series_id, date, round(rsi, 6) as rsi from indicated")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return series.rsi(_prices(spark, sf)).select("series_id", "date", F.round("rsi", 6).alias("rsi"))


@query(
    "price_indicators",
    f"""with {INDICATED_CTE} select series_id, date, close, volume, round(macd, 3) + 0.0 as macd,
    round(signal, 3) + 0.0 as signal, round(ema, 3) as ema, round(rsi, 6) as rsi from indicated""",
)
def price_indicators(spark: SparkSession, sf: str) -> DataFrame:
    found = series.price_indicators(_prices(spark, sf))
    return found.withColumns(
        {c: F.round(c, 3) + F.lit(0.0) for c in ("macd", "signal")} | {"ema": F.round("ema", 3), "rsi": F.round("rsi", 6)}
    )


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return fx.prices(spark, sf).select(F.col("series_id").alias("source"), "date", *COLUMNS)


@query("chronological_split", f"with {fx.PRICES_CTE}, {SPLIT_CTE} select source, date, close, split from splits")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    return ex.chronological_split(_features(spark, sf)).select("source", "date", "close", "split")


@query("tail_n", f"with {fx.PRICES_CTE}, {SPLIT_CTE} select source, date, close from splits where split = 'test'")
def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    return ex.tail_n(_features(spark, sf), 60).select("source", "date", "close")


FIT_CTE = (
    "fit as (select source, "
    + ", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max" for c in COLUMNS)
    + " from splits where split = 'train' group by source)"
)


@query("fit_min_max", f"with {fx.PRICES_CTE}, {SPLIT_CTE}, {FIT_CTE} select * from fit")
def fit_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return ex.fit_min_max(ex.chronological_split(_features(spark, sf)), COLUMNS)


SCALED = ", ".join(f"round(({c} - {c}_min) / ({c}_max - {c}_min), 9) as {c}" for c in COLUMNS)


@query(
    "scale_min_max",
    f"with {fx.PRICES_CTE}, {SPLIT_CTE}, {FIT_CTE} select source, date, split, {SCALED} from splits join fit using (source)",
)
def scale_min_max(spark: SparkSession, sf: str) -> DataFrame:
    split = ex.chronological_split(_features(spark, sf))
    scaled = ex.scale_min_max(split, ex.fit_min_max(split, COLUMNS), COLUMNS)
    return scaled.select("source", "date", "split", *[F.round(c, 9).alias(c) for c in COLUMNS])


@query("inverse_scale", f"with {fx.PRICES_CTE}, {SPLIT_CTE} select source, date, round(close, 4) as restored from splits where split = 'test'")
def inverse_scale(spark: SparkSession, sf: str) -> DataFrame:
    split = ex.chronological_split(_features(spark, sf))
    fit = ex.fit_min_max(split, COLUMNS)
    scaled = ex.scale_min_max(split, fit, COLUMNS).where("split = 'test'")
    restored = ex.inverse_scale(scaled.withColumn("restored", F.col("close")), fit, "close", ["restored"])
    return restored.select("source", "date", F.round("restored", 4).alias("restored"))


def _cents(values: Column) -> Column:
    """Numbers of an array as whole hundredths joined by commas, for comparison across engines."""
    return F.array_join(F.transform(values, lambda v: F.round(v * 100).cast("bigint").cast("string")), ",")


WINDOW_SQL = f"""with {fx.PRICES_CTE}, {SPLIT_CTE}, numbered as (
      select *, row_number() over w as n,
             list([close, high, volume]) over (w rows between 30 preceding and 1 preceding) as x
      from splits window w as (partition by source, split order by date))"""
CENTS_SQL = "array_to_string([cast(cast(round(v * 100) as bigint) as varchar) for v in flatten(x)], ',')"


@query(
    "sliding_examples",
    f"""{WINDOW_SQL} select source, split, date, close as y, cast(len(x) as int) as rows_back, x[1][1] as first_close,
    x[30][1] as last_close, round(list_sum([r[3] for r in x]), 4) as volume_sum from numbered where n > 30""",
)
def sliding_examples(spark: SparkSession, sf: str) -> DataFrame:
    split = ex.chronological_split(_features(spark, sf), position="place")
    found = ex.sliding_examples(split, "close", ["high", "volume"], position="place")
    total = F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r["f3"])
    return found.select(
        "source",
        "split",
        "date",
        "y",
        F.size("x").alias("rows_back"),
        F.get("x", F.lit(0))["f1"].alias("first_close"),
        F.get("x", F.lit(29))["f1"].alias("last_close"),
        F.round(total, 4).alias("volume_sum"),
    )


@query("flatten_examples", f"{WINDOW_SQL} select source, split, date, md5({CENTS_SQL}) as x_digest, 90 as width from numbered where n > 30")
def flatten_examples(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    split = ex.chronological_split(_features(spark, sf), position="place")
    flat = ex.flatten_examples(ex.sliding_examples(split, "close", ["high", "volume"], position="place"), 3)
    values = flat.withColumn("v", vector_to_array("features"))
    return values.select("source", "split", "date", F.md5(_cents(F.col("v"))).alias("x_digest"), F.size("v").alias("width"))


PAIRED = ("open", "high", "low", "close", "volume", "constant")


@query(
    "correlation_matrix",
    f"with {fx.PRICES_CTE}, f as (select *, 1.0::double as constant, case when day(date) % 3 <> 0 then low end as gappy from prices) "
    + " union all ".join(
        f"select '{a}' as feature_a, '{b}' as feature_b, "
        + ("cast(max(null) as double)" if "constant" in (a, b) else f"round(corr({a.replace('low', 'gappy')}, {b.replace('low', 'gappy')}), 6)")
        + " as corr from f"
        for i, a in enumerate(PAIRED)
        for b in PAIRED[:i]
    ),
)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    prices = fx.prices(spark, sf).withColumns({"constant": F.lit(1.0), "low": F.when(F.dayofmonth("date") % 3 != 0, F.col("low"))})
    return stats.correlation_matrix(prices, PAIRED).withColumn("corr", F.round("corr", 6))


@query(
    "rmse",
    f"with {INDICATED_CTE} select series_id, round(sqrt(avg((ema - close) * (ema - close))), 3) as rmse from indicated group by series_id",
)
def rmse(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the moving average as a forecast of the close."""
    smoothed = series.ema(_prices(spark, sf))
    return stats.rmse(smoothed, "close", "ema", ["series_id"]).withColumn("rmse", F.round("rmse", 3))
