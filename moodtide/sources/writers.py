"""Sinks. Every stage of the work can be stored and picked up again from its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bound on the rows of one output file, so that a big source still gives readable files.
ROWS_PER_FILE = 5_000_000


#: CSV that keeps blanks, line breaks and the difference between null and ''.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _write(df: DataFrame, path: str, by: Sequence[str], fmt: str, order: Sequence[str] = (), **options: str) -> None:
    """Write one folder per value of ``by`` and replace just those folders; others stay.

    Rows are rebalanced first: a folder gets as many files as its size asks for, and a dominant value
    is split between tasks.
    """
    even = df.hint("rebalance", *by)
    writer = (even.sortWithinPartitions(*order) if order else even).write.mode("overwrite").format(fmt)
    writer = writer.option("maxRecordsPerFile", ROWS_PER_FILE).option("partitionOverwriteMode", "dynamic").options(**options)
    writer.partitionBy(*by).save(path)


def write_posts(df: DataFrame, path: str, by: str = "community") -> None:
    """Fetched posts, one folder per community."""
    _write(df, path, [by], "parquet")


def write_scored(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scored posts, one folder per source; sources that are not among them keep what they have."""
    _write(df, path, ["source"], fmt, **(CSV_OPTIONS if fmt == "csv" else {}))


def write_daily(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Daily features, one folder per source, in date order within a file."""
    _write(df, path, ["source"], fmt, ["source", "date"], **(CSV_OPTIONS if fmt == "csv" else {}))


def write_predictions(df: DataFrame, path: str, model: str, target: str) -> None:
    """Truth and prediction per forecast row, one folder per model and target; other runs stay."""
    _write(df.withColumns({"model": F.lit(model), "target": F.lit(target)}), path, ["model", "target"], "parquet")
