"""Cleaning, unification and windowing of posts. Everything but the aggregates is row-local."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.functions import scores, text

#: What a site leaves behind in place of a removed title or body.
REMOVED_MARKERS = ("[removed]", "[deleted]")


def fill_text_nulls(df: DataFrame, columns: Sequence[str] = ("title", "selftext")) -> DataFrame:
    return df.na.fill("", list(columns))


def build_text(df: DataFrame, limit: int | None = 500) -> DataFrame:
    """Add ``text``; posts are cut at 500 characters, chat messages (``limit=None``) are not."""
    return df.withColumn("text", text.post_text(F.col("title"), F.col("selftext"), limit))


def _typed(name: str, kind: str, default: float) -> Column:
    number = F.col(name).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(None)).try_cast(kind), F.lit(default).cast(kind))


def cast_defaults(df: DataFrame) -> DataFrame:
    """Typed engagement columns; missing or unreadable values become 0 comments, score 1, ratio 1."""
    return df.withColumns(
        {
            "num_comments": _typed("num_comments", "int", 0),
            "score": _typed("score", "int", 1),
            "upvote_ratio": _typed("upvote_ratio", "float", 1.0),
        }
    )


def drop_missing_time(df: DataFrame, column: str = "created_utc") -> DataFrame:
    return df.na.drop(subset=[column])


def epoch_to_date(df: DataFrame, column: str = "created_utc") -> DataFrame:
    """Add the UTC ``date`` of epoch seconds, whatever the session time zone is."""
    days = F.floor(F.col(column).try_cast("double") / 86400).cast("int")
    return df.withColumn("date", F.date_from_unix_date(days))


def iso_to_date(df: DataFrame, column: str = "date") -> DataFrame:
    """Replace an ISO time string by its ``date`` as written, without zone conversion."""
    return df.withColumn("date", F.col(column).cast("string").substr(1, 10).try_cast("date"))


def flatten_messages(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, text.flatten_rich_text(F.col(column)))


def unify_source(df: DataFrame) -> DataFrame:
    """Give chat messages the columns of posts: the text is the title, engagement is constant."""
    return df.withColumns(
        {
            "title": F.col("text"),
            "selftext": F.lit(""),
            "num_comments": F.lit(0),
            "score": F.lit(1),
            "upvote_ratio": F.lit(1.0).cast("float"),
        }
    )


def is_marked(markers: Sequence[str] = REMOVED_MARKERS) -> Column:
    """True where title or body holds any marker, case-sensitively."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "selftext")]
    return reduce(or_, [field.contains(F.lit(marker)) for marker in markers for field in fields])


def drop_marked(df: DataFrame, markers: Sequence[str] = REMOVED_MARKERS, enabled: bool = True) -> DataFrame:
    return df.where(~is_marked(markers)) if enabled else df


def cleaning_report(df: DataFrame, markers: Sequence[str] = REMOVED_MARKERS, time: str = "date") -> DataFrame:
    """Per source: posts in, dropped for a marker or a missing time, kept, and kept without a weight."""
    marked, timeless = is_marked(markers), F.col(time).isNull()
    kept = ~marked & ~timeless
    weight = scores.engagement_weight(F.lit(1.0), F.col("score"), F.col("num_comments"), F.col("upvote_ratio"))
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("posts_in"),
        F.count_if(marked).alias("marked"),
        F.count_if(timeless & ~marked).alias("without_time"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & weight.isNull()).alias("without_weight"),
    )


def dedupe_posts(
    df: DataFrame,
    keys: Sequence[str] = ("source", "id"),
    prefer: Sequence[str] = ("num_comments", "score"),
) -> DataFrame:
    """One row per post: the copy with the highest ``prefer`` columns, other columns breaking ties.

    A row without a full key is a post of its own and stays.
    Spark applies the rank limit before the shuffle as well, so many copies of one post shrink to
    one per task first.
    """
    rest = [c for c, kind in df.dtypes if c not in keys and c not in prefer and kind != "variant"]
    order = [F.col(c).desc_nulls_last() for c in prefer] + [F.col(c).asc_nulls_last() for c in rest]
    nameless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    known = df.withColumn("_own", F.when(nameless, F.monotonically_increasing_id()))
    copies = W.partitionBy(*keys, "_own").orderBy(*order)
    return known.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy", "_own")


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def select_features(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ("source", "date")) -> DataFrame:
    """The keys, the target and the features, in this order."""
    return df.select(*keys, target, *[c for c in features if c != target])


def strip_prefix(df: DataFrame, prefix: str = "BTC / ", drop: Sequence[str] = ("date",)) -> DataFrame:
    kept = df.drop(*drop)
    return kept.toDF(*[c.replace(prefix, "") for c in kept.columns])


def window_start(day: Column, days: int = 5) -> Column:
    """First day of the fetch window holding ``day``; windows restart on 1 January."""
    steps = F.floor((F.dayofyear(day) - 1) / days).cast("int") * days
    return F.date_add(F.trunc(day, "year").cast("date"), steps)


def window_end(start: Column, days: int = 5) -> Column:
    """Day after the window that begins on ``start``; the last window of a year is short."""
    new_year = F.add_months(F.trunc(start, "year"), 12)
    return F.least(F.date_add(start, days), new_year)


def fetch_windows(df: DataFrame, date: str = "date", days: int = 5, source: str = "source") -> DataFrame:
    """Rows per source and fetch window, windows without rows included.

    A window counts when it lies between the first and the last window of its source.
    """
    counted = df.groupBy(source, window_start(F.col(date), days).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    span = counted.groupBy(source).agg(F.min("window_start").alias("_lo"), F.max("window_start").alias("_hi"))
    year_starts = F.sequence(F.trunc("_lo", "year").cast("date"), F.col("_hi"), F.expr("interval 1 year"))
    last_step = (366 - 1) // days * days
    steps = F.sequence(F.lit(0), F.lit(last_step), F.lit(days))
    spine = (
        span.select(source, "_lo", "_hi", F.explode(year_starts).alias("_year"))
        .select(source, "_lo", "_hi", "_year", F.explode(steps).alias("_step"))
        .withColumn("window_start", F.date_add("_year", F.col("_step")))
        .where(F.col("window_start").between(F.col("_lo"), F.col("_hi")))
        .where(F.year("window_start") == F.year("_year"))
    )
    return spine.join(counted, [source, "window_start"], "left").select(
        source,
        "window_start",
        window_end(F.col("window_start"), days).alias("window_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
