"""Supervised examples from daily features: split, scaling and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.operators.series import with_series_position

#: Rows an example looks back on, and rows predicted at the end of a series.
WINDOW_ROWS = 30
TEST_ROWS = 60

#: Examples built in one task: rows of a series are cut into runs of this many.
RUN_ROWS = 256


def tail_n(df: DataFrame, n: int, keys: Sequence[str] = ("source",), time: str = "date") -> DataFrame:
    """The last ``n`` rows of every source in time order; every task keeps its last ``n`` before the shuffle."""
    latest = W.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= n).drop("_back")


def chronological_split(
    df: DataFrame,
    test_rows: int = TEST_ROWS,
    keys: Sequence[str] = ("source",),
    time: str = "date",
    position: str | None = None,
) -> DataFrame:
    """Add ``split``: the last ``test_rows`` rows of a source are ``test``, the others ``train``.

    ``position`` names a column for the place of a row in its part, which ``sliding_examples`` can use. The input
    is read twice.
    """
    placed = with_series_position(df, keys, time)
    test = F.col("_pos") >= F.col("_len") - test_rows
    split = placed.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
    if position:
        first = F.greatest(F.col("_len") - test_rows, F.lit(0))
        split = split.withColumn(position, F.col("_pos") - F.when(test, first).otherwise(0))
    return split.drop("_pos", "_len")


def fit_min_max(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source",)) -> DataFrame:
    """Smallest and largest value of each column over the training rows of a source."""
    train = df.where("split = 'train'") if "split" in df.columns else df
    bounds = [f(c).cast("double").alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return train.groupBy(*keys).agg(*bounds)


def _width(c: str) -> Column:
    """Range of a column; a constant column counts as range 1."""
    width = F.col(f"{c}_max") - F.col(f"{c}_min")
    return F.when(width == 0, F.lit(1.0)).otherwise(width)


def scale_min_max(df: DataFrame, fit: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source",)) -> DataFrame:
    """Scale by the training range; test values may leave [0, 1].

    A source without training rows keeps its rows with null values. ``fit`` has one row per source:
    adaptive execution broadcasts it while it is small, and splits the rows of a dominant source otherwise.
    """
    scaled = {c: (F.col(c).cast("double") - F.col(f"{c}_min")) / _width(c) for c in columns}
    return df.join(fit, list(keys), "left").withColumns(scaled).select(*df.columns)


def inverse_scale(df: DataFrame, fit: DataFrame, column: str, values: Sequence[str], keys: Sequence[str] = ("source",)) -> DataFrame:
    """Undo the scaling of ``column`` in each of the ``values`` columns; null for a source without a fit."""
    restored = {v: F.col(v) * _width(column) + F.col(f"{column}_min") for v in values}
    bounds = fit.select(*keys, f"{column}_min", f"{column}_max")
    return df.join(bounds, list(keys), "left").withColumns(restored).select(*df.columns)


def sliding_examples(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    window: int = WINDOW_ROWS,
    keys: Sequence[str] = ("source", "split"),
    time: str = "date",
    position: str | None = None,
) -> DataFrame:
    """One example per row that has ``window`` rows before it in its group.

    ``x`` holds those rows, target first and features after it, and ``y`` the target of the row
    itself. A group is cut into runs of rows; a run also receives the last rows of the run before
    it, so that every example is complete and no task holds more than one run. Rows are numbered in time
    order unless ``position`` names a column that does so, from 0 in each group.
    """
    run_rows = max(RUN_ROWS, window)
    columns = [target, *[c for c in features if c != target]]
    if position:
        placed = df.select(*keys, time, *columns, F.col(position).alias("_pos"))
    else:
        placed = with_series_position(df.select(*keys, time, *columns), keys, time)
    run = F.floor(F.col("_pos") / run_rows)
    also_next = F.col("_pos") % run_rows >= run_rows - window
    copies = placed.withColumn("_own", run).withColumn(
        "_run", F.explode(F.when(also_next, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    back = W.partitionBy(*keys, "_run").orderBy("_pos").rowsBetween(-window, -1)
    row = F.struct(*[F.col(c).cast("double").alias(f"f{i + 1}") for i, c in enumerate(columns)])
    return (
        copies.withColumn("x", F.collect_list(row).over(back))
        .where((F.col("_run") == F.col("_own")) & (F.col("_pos") >= window))
        .select(*keys, time, "x", F.col(target).cast("double").alias("y"))
    )


def flat_values(x: Column, width: int) -> Column:
    """The values of an example in time order, row after row; a missing one is NaN."""
    gap = F.lit(float("nan"))
    return F.flatten(F.transform(x, lambda s: F.array(*[F.coalesce(s[f"f{i + 1}"], gap) for i in range(width)])))


def flatten_examples(df: DataFrame, width: int, out: str = "features") -> DataFrame:
    """Replace ``x`` by a vector of ``width`` values per row of the window."""
    return df.withColumn(out, array_to_vector(flat_values(F.col("x"), width))).drop("x")
