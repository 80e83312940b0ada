"""Descriptive statistics and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import factorial, pi, sqrt
from operator import add, mul

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.functions import scores
from moodtide.functions.text import counted_words
from moodtide.session import small_side, with_global_position


def _counted(df: DataFrame, stopwords: DataFrame | None, text: str) -> DataFrame:
    """The words of all texts, one row an occurrence, stop words left out."""
    words = df.select(F.explode(counted_words(F.col(text))).alias("term"))
    if stopwords is None:
        return words.where(~F.col("term").isin(StopWordsRemover.loadDefaultStopWords("english")))
    return words.join(small_side(stopwords.select("term")), "term", "left_anti")


def word_counts(df: DataFrame, stopwords: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Occurrences of every word, stop words left out.

    ``stopwords`` is a table with a ``term`` column; without it Spark's English list is used.
    Tasks count their own words before the shuffle, so a common word is no hot key.
    """
    return _counted(df, stopwords, text).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_words(counts: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` most frequent words, ties in alphabetical order."""
    return counts.orderBy(F.col("n").desc(), "term").limit(k)


def heavy_hitters(words: DataFrame, k: int, tracked: int = 1 << 17, column: str = "term") -> DataFrame | None:
    """The values that can be among the ``k`` most frequent ones, a few more than ``k``; None where that cannot be told.

    Every task sums its rows up in a sketch of ``tracked`` counters, and the sketches are merged, so what is moved depends on the
    number of tasks, not on the number of values. An estimate is never too low, and too high by 3.5 / ``tracked`` of all rows
    at most: a value that is estimated below the ``k``-th estimate less that much is out.
    """
    wanted = min(4 * k, tracked // 2)
    sketch = F.expr(f"approx_top_k({column}, {wanted}, {tracked})")
    seen, found = words.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)), sketch).head()
    found = [(r["item"], r["count"]) for r in found or []]
    error = 3.5 * seen / tracked
    if len(found) <= k:  # all there are, if no counter has been given up
        return words.sparkSession.createDataFrame(found, f"{column} string, estimate long").select(column) if error < 1 else None
    least = found[k - 1][1] - error
    if least <= error or (len(found) == wanted and found[-1][1] >= least):
        return None
    return words.sparkSession.createDataFrame([f for f in found if f[1] >= least], f"{column} string, estimate long").select(column)


def word_frequency(df: DataFrame, k: int = 200, stopwords: DataFrame | None = None, text: str = "text", tracked: int = 1 << 17) -> DataFrame:
    """The ``k`` most frequent words with their exact counts, ties in alphabetical order.

    A sketch of the words tells which of them can be among the first; only those are counted, in a second reading.
    Where words are so evenly frequent that the sketch cannot tell, all are counted.
    """
    words = _counted(df, stopwords, text)
    likely = heavy_hitters(words, k, tracked)
    if likely is None:
        return top_words(word_counts(df, stopwords, text), k)
    chosen = words.join(F.broadcast(likely), "term", "left_semi")  # four times k rows at most
    return top_words(chosen.groupBy("term").agg(F.count(F.lit(1)).alias("n")), k)


def _binned(df: DataFrame, columns: Sequence[str], lo: float, hi: float, bins: int) -> DataFrame:
    """Long form ``(metric, bin, value)``; the upper bound belongs to the last bin.

    Values below ``lo`` are in bin 0, values above ``hi`` in bin ``bins + 1``; nulls and NaN are left out.
    """
    long = df.unpivot([], list(columns), "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    place = F.width_bucket("value", F.lit(float(lo)), F.lit(float(hi)), F.lit(bins))
    place = F.when(F.col("value") == float("inf"), bins + 1).when(F.col("value") == -float("inf"), 0).otherwise(place)
    return long.withColumn("bin", F.when(F.col("value") == hi, bins).otherwise(place).cast("int"))


def score_histogram(
    df: DataFrame, columns: Sequence[str] = ("sia_vader", "sia_bert"), lo: float = -1.0, hi: float = 1.0, bins: int = 50
) -> DataFrame:
    """Rows per score column and bin of equal width; empty bins are left out.

    Outliers are counted in bin 0 and bin ``bins + 1``, which have one open end (null).
    """
    width = (hi - lo) / bins
    edge = F.lit(lo) + (F.col("bin") - 1) * width
    return (
        _binned(df, columns, lo, hi, bins)
        .groupBy("metric", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"lower": F.when(F.col("bin") > 0, edge), "upper": F.when(F.col("bin") <= bins, F.lit(lo) + F.col("bin") * width)})
    )


def auto_histogram(df: DataFrame, columns: Sequence[str] = ("sia_vader", "sia_bert"), most: int = 50, accuracy: int = 100_000) -> DataFrame:
    """Rows per score column and bin between its least and largest value, the width following from the data.

    The width is twice the distance of the quartiles divided by the cube root of the number of values, made smaller so that
    whole bins fill the range; ``most`` bins at most, and as many as the root of the number where the quartiles are equal.
    The quartiles come from a mergeable sketch whose ranks are off by 1 / ``accuracy`` of the rows at most. Values that are
    not finite are left out, empty bins too; equal values make one bin without width.
    """
    long = df.unpivot([], list(columns), "metric", "value").withColumn("value", F.col("value").cast("double"))
    long = long.where(F.abs("value") < float("inf"))
    quartiles = F.percentile_approx("value", [0.25, 0.75], accuracy)
    facts = long.groupBy("metric").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), quartiles.alias("_q"))
    step = 2 * (F.col("_q")[1] - F.col("_q")[0]) / F.pow(F.col("_n"), F.lit(1 / 3))
    bins = F.when(step > 0, F.ceil(F.try_divide(F.col("_hi") - F.col("_lo"), step))).otherwise(F.floor(F.sqrt("_n")))
    bins = F.when(F.col("_hi") > F.col("_lo"), F.least(F.greatest(bins, F.lit(1)), F.lit(most))).otherwise(1)
    facts = facts.withColumn("bins", bins.cast("int")).withColumn("width", (F.col("_hi") - F.col("_lo")) / F.col("bins"))
    place = F.floor(F.try_divide(F.col("value") - F.col("_lo"), F.col("width")))
    bin_ = F.least(F.coalesce(place, F.lit(0)) + 1, F.col("bins").cast("long")).cast("int")
    rows = long.join(F.broadcast(facts), "metric")  # a row a column
    counted = rows.groupBy("metric", bin_.alias("bin"), "_lo", "width").agg(F.count(F.lit(1)).alias("n"))
    lower, upper = (F.col("_lo") + (F.col("bin") - k) * F.col("width") for k in (1, 0))
    return counted.select("metric", "bin", "n", lower.alias("lower"), upper.alias("upper"))


#: Powers of a value's distance from the middle of its bin that the density keeps.
MOMENTS = 8


def _hermite(order: int) -> list[float]:
    """The coefficients, constant first, of the Hermite polynomial He of ``order``."""
    before, last = [0.0], [1.0]
    for k in range(order):
        shifted = [0.0, *last]
        less = [k * c for c in before] + [0.0] * (len(shifted) - len(before))
        before, last = last, [a - b for a, b in zip(shifted, less)]
    return last


def score_density(
    df: DataFrame,
    columns: Sequence[str] = ("sia_vader", "sia_bert"),
    lo: float = -1.0,
    hi: float = 1.0,
    bins: int = 200,
    points: int = 101,
    bandwidth: float | None = None,
) -> DataFrame:
    """Gaussian kernel density of each score column on ``points`` equally spaced places, with its error ``bound``.

    The rows are reduced to the moments of each bin of width d = (``hi`` - ``lo``) / ``bins``, and every kernel is expanded around
    the middle of its bin up to ``MOMENTS`` powers. With the bandwidth h and r = d / 2h, what is cut off is less than
    1.09 r^p / sqrt(p!) / (1 - r) / (h sqrt(2 pi)), p being ``MOMENTS``; ``bound`` is null where r is not below 1, which more bins
    mend. Bins go on beyond ``lo`` and ``hi``. The default bandwidth is Scott's rule on the exact moments. Values that are not
    finite are left out. Null where all scores are equal and no bandwidth is given.
    """
    step = (hi - lo) / bins
    long = df.unpivot([], list(columns), "metric", "value").withColumn("value", F.col("value").cast("double"))
    long = long.where(F.abs("value") < float("inf")).withColumn("bin", F.floor((F.col("value") - lo) / step))
    off = (F.col("value") - lo) / step - F.col("bin") - 0.5  # from the middle, in widths
    powers = [F.sum(reduce(mul, [off] * k)).alias(f"_m{k}") if k else F.count(F.lit(1)).cast("double").alias("_m0") for k in range(MOMENTS)]
    reduced = long.groupBy("metric", "bin").agg(*powers, F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    whole = W.partitionBy("metric")  # at most one row per bin
    total = F.sum("_m0").over(whole)
    spread = F.sum("s2").over(whole) - F.pow(F.sum("s").over(whole), F.lit(2.0)) / total
    scott = F.sqrt(F.greatest(F.try_divide(spread, total - 1), F.lit(0.0))) * F.pow(total, F.lit(-0.2))
    h = F.lit(bandwidth).cast("double") if bandwidth else F.when(scott > 0, scott)
    kernels = reduced.withColumns({"_total": total, "_h": h})
    # one coefficient for each power of the place: the moments meet the polynomials that belong to them
    scaled = [F.col(f"_m{k}") * F.pow(F.lit(step) / F.col("_h"), F.lit(k)) / factorial(k) for k in range(MOMENTS)]
    polynomials = [_hermite(k) for k in range(MOMENTS)]
    terms = [reduce(add, [scaled[k] * c[power] for k, c in enumerate(polynomials) if power < len(c) and c[power]]) for power in range(MOMENTS)]
    middle = F.lit(lo) + (F.col("bin") + 0.5) * step
    kernels = kernels.select("metric", middle.alias("_middle"), "_total", "_h", *[t.alias(f"_c{power}") for power, t in enumerate(terms)])
    spacing = (hi - lo) / (points - 1)
    grid = kernels.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.lit(lo) + F.col("point") * spacing
    grid = grid.withColumn("_t", (at - F.col("_middle")) / F.col("_h"))
    value = reduce(lambda sum_, power: sum_ * F.col("_t") + F.col(f"_c{power}"), range(MOMENTS - 2, -1, -1), F.col(f"_c{MOMENTS - 1}"))
    near = value * F.exp(F.col("_t") * F.col("_t") * -0.5) / (F.col("_total") * F.col("_h") * sqrt(2.0 * pi))
    ratio = F.lit(step) / (F.col("_h") * 2)
    cut = F.pow(ratio, F.lit(MOMENTS)) * 1.09 / sqrt(factorial(MOMENTS)) / (1 - ratio) / (F.col("_h") * sqrt(2.0 * pi))
    found = grid.groupBy("metric", "point").agg(F.sum(near).alias("density"), F.max(F.when(ratio < 1, cut)).alias("bound"))
    return found.withColumn("x", at)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows where both are present.

    One aggregation over the data. Lower triangle without the diagonal, one row per pair; null
    when either column is constant.
    """

    def pair(a: str, b: str) -> Column:
        x, y = (F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in (a, b))
        spread = F.sqrt(F.var_pop(F.when(y.isNotNull(), x)) * F.var_pop(F.when(x.isNotNull(), y)))
        return F.try_divide(F.covar_pop(x, y), spread)

    pairs = [(b, a) for a, b in combinations(columns, 2)]
    wide = df.agg(*[pair(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"_{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def rmse(df: DataFrame, truth: str = "truth", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Root of the mean squared error, per group if ``by`` is given."""
    error = F.col(prediction) - F.col(truth)
    return df.groupBy(*by).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def batch_metrics(
    df: DataFrame, order: Sequence[str], logit: str = "logit", label: str = "label", batch_size: int = 32, position: str | None = None
) -> DataFrame:
    """Accuracy as the plain mean over batches, loss as the sum over batches of the mean loss.

    Batches are cut in the total order given by ``order``, or by the numbers that ``position`` already holds; a
    short last batch counts in full.
    """
    z, y = F.col(logit).cast("double"), F.col(label)
    kept = [F.col(position).alias("position")] if position else list(order)
    narrow = df.select(*kept, z.alias("_z"), y.cast("double").alias("_y"))
    batch = F.floor(F.col("position") / batch_size)
    right = scores.accuracy_flag(scores.sigmoid(F.col("_z")), F.col("_y")).cast("double")
    per_batch = (
        (narrow if position else with_global_position(narrow, list(order)))
        .groupBy(batch.alias("batch"))
        .agg(F.avg(right).alias("_accuracy"), F.avg(scores.binary_cross_entropy(F.col("_z"), F.col("_y"))).alias("_loss"))
    )
    return per_batch.agg(
        F.avg("_accuracy").alias("accuracy"), F.sum("_loss").alias("loss"), F.count(F.lit(1)).alias("batches")
    )


def select_best(df: DataFrame, metric: str, step: str, by: Sequence[str] = ()) -> DataFrame:
    """The row with the highest metric per group; the earliest step wins a tie."""
    rank = F.struct(F.col(metric), -F.col(step))
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), rank).alias("_best")
    return df.where(F.col(metric).isNotNull()).groupBy(*by).agg(best).select(*by, "_best.*")
