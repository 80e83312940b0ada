"""Exponential averages and other running values over daily series.

A series is cut into blocks of calendar days. Rows of a block are handled in one window task,
each block leaves one row of carries, and the carries of a series are folded in order. A block
holds at most one row per day and a series at most one carry per block, so no task grows with the
length or the share of a series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import floor, log10
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.session import materialise

#: Days in a block, and the power of ten the weights of a block may reach.
BLOCK_DAYS = 256
MAX_WEIGHT_EXPONENT = 200


@dataclass(frozen=True)
class Ewm:
    """An exponential mean of ``value`` with smoothing factor ``alpha``, named ``out``."""

    value: str
    alpha: float
    out: str

    @classmethod
    def span(cls, value: str, span: int, out: str) -> Ewm:
        return cls(value, 2.0 / (span + 1.0), out)

    def __post_init__(self) -> None:
        if not 0.0 < self.alpha < 1.0:
            raise ValueError("alpha must lie between 0 and 1")

    @property
    def decay(self) -> float:
        return 1.0 - self.alpha


def _block(time: str, days: int) -> Column:
    return F.floor(F.unix_date(F.col(time)) / days)


def _block_days(specs: Sequence[Ewm]) -> int:
    """Days per block so that the inverse weights stay finite."""
    limits = [MAX_WEIGHT_EXPONENT / -log10(s.decay) for s in specs]
    return max(1, min([BLOCK_DAYS, *map(floor, limits)]))


def ewm_means(
    df: DataFrame,
    specs: Sequence[Ewm],
    keys: Sequence[str] = ("series_id",),
    time: str = "date",
    previous: dict[str, str] | None = None,
) -> DataFrame:
    """Add exponentially weighted means with normalised weights, all in one pass.

    ``time`` is a DATE, unique per series. Weights decay by one step per row; a null value adds
    nothing and repeats the mean before it, and leading nulls give null. ``previous`` maps a column
    to the name under which its value of the row before is added.

    The input is read for the rows and for the carries, from one shuffle of both: a frame that is dear to
    compute is stored by the caller.
    """
    previous = previous or {}
    keys = list(keys)
    block = [*keys, "_block"]
    ordered = W.partitionBy(*block).orderBy(time)
    running = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = df.withColumn("_block", _block(time, _block_days(specs))).withColumn("_i", F.row_number().over(ordered) - 1)

    # Inside a block both the weighted sum and the sum of weights are running sums.
    inside = {f"_prev_{c}": F.lag(c).over(ordered) for c in previous}
    for k, spec in enumerate(specs):
        grown, shrunk = (F.pow(F.lit(spec.decay), power) for power in (-F.col("_i"), F.col("_i")))
        value = F.col(spec.value).cast("double")
        weighed, weight = F.sum(value * grown).over(running), F.sum(F.when(value.isNotNull(), grown)).over(running)
        inside[f"_num{k}"] = shrunk * F.coalesce(weighed, F.lit(0.0))
        inside[f"_den{k}"] = shrunk * F.coalesce(weight, F.lit(0.0))
    rows = numbered.withColumns(inside)

    states = [f"_{part}{k}" for k in range(len(specs)) for part in ("num", "den")]
    carried = states + [f"_last_{c}" for c in previous]
    ends = [F.max_by(c, "_i").alias(c) for c in states] + [
        F.max_by(F.col(c), "_i").cast("double").alias(f"_last_{c}") for c in previous
    ]
    blocks = rows.groupBy(*block).agg((F.max("_i") + 1).alias("_rows"), *ends)
    ordered_blocks = F.array_sort(F.collect_list(F.struct("_block", "_rows", *carried)))

    fields = ["_block: bigint", *[f"{c}: double" for c in carried]]
    start = F.struct(
        F.array().cast(f"array<struct<{', '.join(fields)}>>").alias("seen"),
        *[F.lit(0.0).alias(c) for c in states],
        *[F.lit(None).cast("double").alias(f"_last_{c}") for c in previous],
    )

    def fold(acc: Column, b: Column) -> Column:
        seen = F.concat(acc["seen"], F.array(F.struct(b["_block"], *[acc[c].alias(c) for c in carried])))
        moved = []
        for k, spec in enumerate(specs):
            fade = F.pow(F.lit(spec.decay), b["_rows"])
            moved += [(fade * acc[c] + b[c]).alias(c) for c in (f"_num{k}", f"_den{k}")]
        lasts = [b[f"_last_{c}"].alias(f"_last_{c}") for c in previous]
        return F.struct(seen.alias("seen"), *moved, *lasts)

    folded = blocks.groupBy(*keys).agg(F.aggregate(ordered_blocks, start, fold)["seen"].alias("_seen"))
    carries = folded.select(*keys, F.inline("_seen").alias("_block", *[f"{c}_before" for c in carried]))

    joined = rows.join(carries, block)
    out = {}
    for k, spec in enumerate(specs):
        fade = F.pow(F.lit(spec.decay), F.col("_i") + 1)
        num = F.col(f"_num{k}") + fade * F.col(f"_num{k}_before")
        den = F.col(f"_den{k}") + fade * F.col(f"_den{k}_before")
        out[spec.out] = F.when(den > 0, num / den)
    for c, name in previous.items():
        first = F.col("_i") == 0
        out[name] = F.when(first, F.col(f"_last_{c}_before")).otherwise(F.col(f"_prev_{c}"))
    return joined.select(*df.columns, *[value.alias(name) for name, value in out.items()])


def ema(df: DataFrame, value: str = "close", span: int = 9, out: str = "ema", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Exponential moving average with the given span."""
    return ewm_means(df, [Ewm.span(value, span, out)], keys)


def macd(
    df: DataFrame,
    value: str = "close",
    fast: int = 12,
    slow: int = 26,
    smooth: int = 9,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Add ``macd``, the fast minus the slow average, and ``signal``, the average of ``macd``."""
    both = materialise(ewm_means(df, [Ewm.span(value, fast, "_fast"), Ewm.span(value, slow, "_slow")], keys))
    line = both.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm_means(line, [Ewm.span("macd", smooth, "signal")], keys)


def _with_moves(df: DataFrame, value: str, before: str) -> DataFrame:
    """Add the rise and the fall since the row before as ``_gain`` and ``_loss``; null on the first row."""
    move = F.col(value) - F.col(before)
    rise, fall = F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))
    return df.withColumns({"_gain": F.when(move.isNotNull(), rise), "_loss": F.when(move.isNotNull(), fall)})


def _strength(gain: Column, loss: Column) -> Column:
    """Relative strength of 0 to 100; 100 without losses, null without any move."""
    return F.when(loss > 0, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + gain / loss)).when(gain > 0, F.lit(100.0))


def rsi(df: DataFrame, value: str = "close", period: int = 14, out: str = "rsi", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Relative strength index from the averages of gains and losses."""
    moves = materialise(_with_moves(ewm_means(df, [], keys, previous={value: "_before"}), value, "_before"))
    specs = [Ewm("_gain", 1.0 / period, "_up"), Ewm("_loss", 1.0 / period, "_down")]
    means = ewm_means(moves, specs, keys)
    return means.withColumn(out, _strength(F.col("_up"), F.col("_down"))).select(*df.columns, out)


def price_indicators(prices: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Prices with ``macd``, ``signal``, ``ema`` and ``rsi`` in two passes.

    The first pass needs only closing prices, the second the values made by the first.
    """
    levels = [Ewm.span("close", 12, "_fast"), Ewm.span("close", 26, "_slow"), Ewm.span("close", 9, "ema")]
    first = materialise(ewm_means(prices, levels, keys, previous={"close": "_before"}))
    first = _with_moves(first.withColumn("macd", F.col("_fast") - F.col("_slow")), "close", "_before")
    changes = [Ewm.span("macd", 9, "signal"), Ewm("_gain", 1 / 14, "_up"), Ewm("_loss", 1 / 14, "_down")]
    second = ewm_means(first, changes, keys)
    return second.withColumn("rsi", _strength(F.col("_up"), F.col("_down"))).select(
        *prices.columns, "macd", "signal", "ema", "rsi"
    )


def carry_forward(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id",), time: str = "date") -> DataFrame:
    """Replace each missing value (null or NaN) of ``columns`` by the last one before it in its series; a leading gap stays.

    ``time`` is a DATE, unique per series. The last value is carried inside calendar blocks, and each block hands on the last
    value that it or a block before it has. The input is read twice, so it should be a stored frame.
    """
    keys = list(keys)
    block = [*keys, "_block"]
    known = {c: F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in columns}
    rows = df.withColumn("_block", _block(time, BLOCK_DAYS)).withColumns(known)
    running = W.partitionBy(*block).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumns({f"_last_{c}": F.last(c, ignorenulls=True).over(running) for c in columns})
    ends = rows.groupBy(*block).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(f"_end_{c}") for c in columns])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    carried = ends.select(*[F.col(b).alias(f"_of_{b}") for b in block], *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in columns])
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in block])
    filled = {c: F.coalesce(f"_last_{c}", f"_before_{c}") for c in columns}
    return inside.join(carried, same).withColumns(filled).select(*df.columns)


def with_series_position(df: DataFrame, keys: Sequence[str], time: str = "date") -> DataFrame:
    """Add ``_pos``, the 0-based place of a row in its series, and ``_len``, the rows of the series.

    ``time`` is a DATE, unique per series. Places are counted inside calendar blocks, and the
    block counts of a series are added up. The input is read twice, so it should be a stored or
    checkpointed frame.
    """
    keys = list(keys)
    block = [*keys, "_block"]
    rows = df.withColumn("_block", _block(time, BLOCK_DAYS))
    series = W.partitionBy(*keys)
    before = series.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(series).alias("_len"))
    )
    inside = F.row_number().over(W.partitionBy(*block).orderBy(time)) - 1
    return rows.withColumn("_in", inside).join(starts, block).withColumn("_pos", F.col("_start") + F.col("_in")).drop(
        "_block", "_in", "_start"
    )
