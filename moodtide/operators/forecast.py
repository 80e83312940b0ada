"""The forecast: examples with their gaps, the search for the best boosting, a linear model, and a stage to store.

A series is what ``keys`` name, a source as a rule. Its training matrix is a few thousand days by a few hundred values, so a
task can hold it: a search broadcasts the matrices of as many series as ``MATRIX_BYTES`` allow, and every task fits one
candidate of one fold. A series above that bound is fitted by Spark's own trees, level by level, over all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from moodtide.operators import boosting
from moodtide.operators import examples as ex
from moodtide.operators.series import carry_forward, with_series_position
from moodtide.operators.stats import rmse, select_best
from moodtide.session import materialise, small_side

#: The full search grid of the forecast.
FULL_GRID = {"maxDepth": (1, 2, 5, 10, 20), "maxIter": (20, 30, 50, 70, 100), "stepSize": (0.1, 0.2, 0.3, 0.4, 0.5)}
#: Penalties of the linear model that a search tries, per training row.
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1)
#: Bytes of training matrices, or of fitted trees, that are broadcast at once.
MATRIX_BYTES = 256 << 20
#: Products of one series that meet in one task of the first round of their addition.
_ADDED = 16


def missing_report(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source",)) -> DataFrame:
    """Per source: its rows, those with all ``columns``, and the values each column lacks."""
    lacks = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    whole = F.lit(True)
    for condition in lacks.values():
        whole = whole & ~condition
    counts = [F.count_if(condition).alias(f"without_{c}") for c, condition in lacks.items()]
    return features.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(whole).alias("complete"), *counts)


def filled_features(features: DataFrame, target: str, columns: Sequence[str], fill: dict[str, float] | None = None, missing: str = "keep") -> DataFrame:
    """``source, date`` and the used columns, stored, with their gaps treated; a row without its target is left out.

    ``fill`` says what stands for a missing value, as 0 posts on a day without posts. Of what is still missing, ``keep``
    leaves gaps, ``ffill`` carries the last value forward and leaves rows out that come before the first one, and ``drop``
    leaves every row with a gap out.
    """
    if missing not in ("keep", "ffill", "drop"):
        raise ValueError(f"missing is keep, ffill or drop, not {missing}")
    used = [target, *[c for c in columns if c != target]]
    filled = features.fillna(fill) if fill else features
    rows = filled.select("source", "date", *used).na.drop(subset=["source", "date"])
    if missing == "ffill":
        rows = carry_forward(materialise(rows.na.drop(subset=[target])), used, ["source"])
    return materialise(rows.na.drop(subset=[target] if missing == "keep" else used))


def prepared_examples(
    features: DataFrame,
    target: str,
    columns: Sequence[str],
    window: int = ex.WINDOW_ROWS,
    test_rows: int = ex.TEST_ROWS,
    fill: dict[str, float] | None = None,
    missing: str = "keep",
) -> tuple[DataFrame, DataFrame]:
    """Flat examples ``(source, split, date, features, y)`` of all sources, and the scaling fit.

    The split comes before the windows, so no test window reaches into training rows. Gaps are treated by
    ``filled_features``; one that is kept is NaN among the values.
    """
    used = [target, *[c for c in columns if c != target]]
    rows = filled_features(features, target, columns, fill, missing)
    split = ex.chronological_split(rows, test_rows, position="position")
    fit = materialise(ex.fit_min_max(split, used))
    windows = ex.sliding_examples(ex.scale_min_max(split, fit, used), target, columns, window, position="position")
    return materialise(ex.flatten_examples(windows, len(used))), fit


def with_fold(examples: DataFrame, folds: int = 2, keys: Sequence[str] = ("source",), time: str = "date") -> DataFrame:
    """Add ``fold``: contiguous parts in time order, not shuffled."""
    placed = with_series_position(examples, list(keys), time)
    return placed.withColumn("fold", F.floor(F.col("_pos") * folds / F.col("_len")).cast("int")).drop("_pos", "_len")


def candidates(grid: dict[str, Sequence]) -> list[tuple[int, int, int, float]]:
    """``candidate, maxDepth, maxIter, stepSize`` of every point of the grid, in its order."""
    points = product(grid["maxDepth"], grid["maxIter"], grid["stepSize"])
    return [(i, int(depth), int(trees), float(step)) for i, (depth, trees, step) in enumerate(points)]


# --- series by number ----------------------------------------------------------------------------


def _numbered(df: DataFrame, keys: Sequence[str], series: DataFrame) -> DataFrame:
    """``df`` with the number ``_series`` of its series; rows of other series are left out."""
    named = series.select("_series", *[F.col(k).alias(f"_key_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(small_side(named), same).drop(*[f"_key_{k}" for k in keys])


def _batches(sizes: list[tuple[int, int]], room: int) -> Iterator[list[int]]:
    """Numbers of series whose sizes go into ``room`` together, one that is larger alone."""
    batch, left = [], room
    for number, size in sizes:
        if batch and size > left:
            yield batch
            batch, left = [], room
        batch.append(number)
        left -= size
    if batch:
        yield batch


def _series_sizes(df: DataFrame, keys: Sequence[str], row_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The series of ``df`` with their numbers, and the bytes of each: a row a series meets on the driver."""
    counted = df.groupBy(*keys).count().collect()
    schema = StructType([*df.select(*keys).schema.fields, StructField("_series", IntegerType())])
    series = df.sparkSession.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(counted)], schema)
    return series, [(i, r["count"] * row_bytes) for i, r in enumerate(counted)]


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


# --- boosting -------------------------------------------------------------------------------------


@dataclass
class Forecasts:
    """Fitted models of all series: ``scores`` of every candidate, the ``chosen`` ones, and what was ``fitted``."""

    keys: tuple[str, ...]
    kind: str
    scores: DataFrame
    chosen: DataFrame
    fitted: DataFrame

    def transform(self, examples: DataFrame) -> DataFrame:
        return (predict_trees if self.kind == "boosted" else predict_linear)(examples, self.fitted, self.keys)


TREES = "tree int, node int, feature int, threshold double, missing_left boolean, left int, value double"


def _tasks(spark: SparkSession, work: list[tuple], run, schema: str) -> DataFrame:
    """One task for each entry of ``work``: ``run`` gives the columns of its rows. The dearest entry comes first."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict(run(*work[i]))

    return spark.range(0, len(work), 1, len(work)).mapInArrow(each, schema)


def train_forecasters(
    examples: DataFrame, grid: dict[str, Sequence] = FULL_GRID, folds: int = 2, keys: Sequence[str] = ("source",)
) -> Forecasts:
    """Grid search of a boosted regressor over the training examples of every series, refit on all of them.

    The score of a candidate is r2, the mean over the folds; the first of the best is chosen. The trees of a shorter boosting
    are the first ones of a longer one, so each fold is fitted once per depth and step size, and every number of trees is
    scored on the way.
    """
    spark, keys = examples.sparkSession, tuple(keys)
    train = examples.where("split = 'train'").select(*keys, "date", vector_to_array("features").alias("x"), "y")
    train = materialise(with_fold(materialise(train), folds, keys))
    width = train.agg(F.max(F.size("x"))).head()[0] or 1
    series, sizes = _series_sizes(train, keys, 8 * (width + 1))
    large = [i for i, size in sizes if size > MATRIX_BYTES]
    if large:
        raise ValueError(f"{len(large)} series do not fit a task; fit them with train_by_levels")
    numbered = _numbered(train, keys, series)
    points = candidates(grid)
    shown = spark.createDataFrame(points, "candidate int, maxDepth int, maxIter int, stepSize double")
    numbers = sorted({p[2] for p in points})
    all_scores, all_chosen, all_trees = [], [], []
    for batch in _batches(sizes, MATRIX_BYTES):
        held = numbered.where(F.col("_series").between(batch[0], batch[-1])).select("_series", "date", "fold", "x", "y").toArrow().sort_by("date")
        of, x = held.column("_series").to_numpy(), _matrix(held.column("x"))
        y, fold = held.column("y").to_numpy(), held.column("fold").to_numpy()
        matrices = spark.sparkContext.broadcast({i: (x[of == i], y[of == i], fold[of == i]) for i in batch})

        def searched(number: int, out: int, depth: int, step: float, matrices=matrices) -> dict:
            mx, my, mf = matrices.value[number]
            found = boosting.staged_scores(mx[mf != out], my[mf != out], mx[mf == out], my[mf == out], depth, step, numbers)
            whole = {"_series": number, "fold": out, "maxDepth": depth}
            columns = {name: pa.array([value] * len(numbers), pa.int32()) for name, value in whole.items()}
            return columns | {"stepSize": pa.array([step] * len(numbers)), "maxIter": pa.array(numbers, pa.int32()), "score": pa.array(found)}

        def refit(number: int, depth: int, trees: int, step: float, matrices=matrices) -> dict:
            mx, my, _ = matrices.value[number]
            return _columns(number, list(boosting.boost(mx, my, depth, step, trees)))

        work = [(n, f, d, s) for d, n, f, s in product(sorted({p[1] for p in points}, reverse=True), batch, range(folds), sorted({p[3] for p in points}))]
        fits = _tasks(spark, work, searched, "_series int, fold int, maxDepth int, stepSize double, maxIter int, score double")
        means = fits.groupBy("_series", "maxDepth", "maxIter", "stepSize").agg(F.avg("score").alias("mean_score"))
        scores = materialise(means.join(F.broadcast(shown), ["maxDepth", "maxIter", "stepSize"]))
        chosen = materialise(select_best(scores, "mean_score", "candidate", ["_series"]))
        again = [(r["_series"], r["maxDepth"], r["maxIter"], r["stepSize"]) for r in chosen.collect()]  # a row a series
        trees = materialise(_tasks(spark, again, refit, f"_series int, {TREES}"))
        matrices.unpersist()
        for kept, found in ((all_scores, scores), (all_chosen, chosen), (all_trees, trees)):
            kept.append(found)
    named = small_side(series)
    columns = [*keys, "candidate", "maxDepth", "maxIter", "stepSize", "mean_score"]
    whole = [reduce(DataFrame.unionByName, found).join(named, "_series") for found in (all_scores, all_chosen, all_trees)]
    return Forecasts(keys, "boosted", whole[0].select(*columns), whole[1].select(*columns), whole[2].drop("_series"))


def _columns(number: int, trees: list[boosting.Tree]) -> dict:
    sizes = [len(t.feature) for t in trees]
    fields = {name: np.concatenate([getattr(t, name) for t in trees]) for name in ("feature", "threshold", "missing_left", "left", "value")}
    return {
        "_series": pa.array(np.full(sum(sizes), number, np.int32)),
        "tree": pa.array(np.repeat(np.arange(len(trees), dtype=np.int32), sizes)),
        "node": pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
        **{name: pa.array(values) for name, values in fields.items()},
    }


def _trees(table: pa.Table) -> list[boosting.Tree]:
    table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
    bounds = np.flatnonzero(np.diff(table.column("tree").to_numpy(), prepend=-1, append=-1))
    fields = [table.column(name).to_numpy() for name in ("feature", "threshold", "missing_left", "left", "value")]
    return [boosting.Tree(*[f[lo:hi] for f in fields]) for lo, hi in zip(bounds, bounds[1:])]


def _predictor(models):
    @F.arrow_udf("double")
    def predicted(number: pa.Array, x: pa.Array) -> pa.Array:
        of, matrix = number.to_numpy(), _matrix(x)
        out = np.full(len(of), boosting.START)
        for i in np.unique(of):
            mine = of == i
            for tree in models.value[int(i)]:
                out[mine] += tree.predict(matrix[mine])
        return pa.array(out)

    return predicted


def predict_trees(examples: DataFrame, trees: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Add ``prediction`` of the series' own trees; examples of a series without trees are left out."""
    spark = examples.sparkSession
    series, sizes = _series_sizes(trees, keys, 64)
    numbered, fitted = _numbered(examples, keys, series), _numbered(trees, keys, series)
    parts = []
    for batch in _batches(sizes, MATRIX_BYTES):
        here = F.col("_series").between(batch[0], batch[-1])
        table = fitted.where(here).toArrow()
        models = spark.sparkContext.broadcast({i: _trees(table.filter(pc.equal(table.column("_series"), i))) for i in batch})

        predicted = _predictor(models)("_series", vector_to_array("features"))
        parts.append(numbered.where(here).withColumn("prediction", predicted).drop("_series"))
    if not parts:
        return examples.where("false").withColumn("prediction", F.lit(0.0))
    return reduce(DataFrame.unionByName, parts)


def train_by_levels(examples: DataFrame, depth: int, trees: int, step: float, seed: int = 7) -> GBTRegressionModel:
    """One boosting over training examples of any size by Spark's trees, a job a level; the examples have no gaps."""
    learner = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=depth, stepSize=step, maxIter=trees, seed=seed)
    return learner.fit(materialise(examples.where("split = 'train'").select("features", "y")))


# --- linear model ---------------------------------------------------------------------------------


def _solved(product_: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and, last, the intercept that minimise the squared error and the penalised weights, by Cholesky."""
    a, rows = product_[:-1, :-1].copy(), product_[-2, -2]
    a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += penalty * rows
    lower = np.linalg.cholesky(a)
    return np.linalg.solve(lower.T, np.linalg.solve(lower, product_[:-1, -1]))


def _r2(product_: np.ndarray, weights: np.ndarray) -> float:
    v = np.append(-weights, 1.0)
    spread = product_[-1, -1] - product_[-1, -2] ** 2 / product_[-2, -2]
    return float(1 - v @ product_ @ v / spread) if spread > 0 else 0.0


def train_linear(
    examples: DataFrame, penalties: Sequence[float] = PENALTIES, folds: int = 2, keys: Sequence[str] = ("source",)
) -> Forecasts:
    """Linear autoregression over all values of an example, for all series at once; the penalty is chosen like a grid point.

    Tasks add up the products of all pairs of values per series and fold, the sums are added in two rounds, and
    everything else follows from them: the fit without a fold, and its error on that fold. Examples have no gaps.
    """
    spark, keys = examples.sparkSession, tuple(keys)
    train = examples.where("split = 'train'").select(*keys, "date", vector_to_array("features").alias("x"), "y")
    train = materialise(with_fold(materialise(train), folds, keys))
    series, _ = _series_sizes(train, keys, 1)
    numbered = _numbered(train, keys, series).select("_series", "fold", "x", "y")
    schema = "_series int, fold int, part int, sums binary"

    def multiplied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
            if np.isnan(x).any():
                raise ValueError("the linear model needs examples without gaps")
            z = np.column_stack([x, np.ones(len(x)), y])
            of = np.column_stack([batch.column("_series").to_numpy(), batch.column("fold").to_numpy()])
            groups, number = np.unique(of, axis=0, return_inverse=True)
            sums = [(z[number.ravel() == g].T @ z[number.ravel() == g]).tobytes() for g in range(len(groups))]
            part = pa.array(np.full(len(groups), hash((n, sums[0][:64])) % _ADDED, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(groups[:, 0], pa.int32()), pa.array(groups[:, 1], pa.int32()), part, pa.array(sums)], ["_series", "fold", "part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s.as_buffer(), np.float64) for s in table.column("sums")], axis=0)
        return table.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    def solved(table: pa.Table) -> pa.Table:
        number = table.column("_series")[0].as_py()
        by_fold = [np.frombuffer(s.as_buffer(), np.float64) for s in table.column("sums")]
        size = int(len(by_fold[0]) ** 0.5)
        by_fold = [f.reshape(size, size) for f in by_fold]
        whole = sum(by_fold)
        scores = [float(np.mean([_r2(f, _solved(whole - f, p)) for f in by_fold])) if len(by_fold) > 1 else 0.0 for p in penalties]
        weights = [_solved(whole, p).tolist() for p in penalties]
        columns = {"_series": [number] * len(penalties), "candidate": list(range(len(penalties))), "penalty": list(penalties)}
        return pa.table({"_series": pa.array(columns["_series"], pa.int32()), "candidate": pa.array(columns["candidate"], pa.int32()), "penalty": columns["penalty"], "mean_score": scores, "weights": weights})

    products = numbered.mapInArrow(multiplied, schema).groupBy("_series", "fold", "part").applyInArrow(added, schema)
    products = products.groupBy("_series", "fold").applyInArrow(added, schema)
    found = "_series int, candidate int, penalty double, mean_score double, weights array<double>"
    scores = materialise(products.groupBy("_series").applyInArrow(solved, found))
    chosen = select_best(scores, "mean_score", "candidate", ["_series"])
    named = small_side(series)
    shown = [*keys, "candidate", "penalty", "mean_score"]
    best = materialise(chosen.join(named, "_series"))
    return Forecasts(keys, "linear", scores.join(named, "_series").select(*shown), best.select(*shown), best.select(*keys, "weights"))


def predict_linear(examples: DataFrame, weights: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Add ``prediction`` of the series' own weights; examples of a series without weights are left out."""
    named = weights.select(F.col("weights").alias("_weights"), *[F.col(k).alias(f"_key_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    values = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    total = F.aggregate(F.zip_with(values, "_weights", lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    return examples.join(small_side(named), same).withColumn("prediction", total).select(*examples.columns, "prediction")


# --- forecasts and experiments --------------------------------------------------------------------


def predict_forecast(model, examples: DataFrame, fit: DataFrame, target: str) -> DataFrame:
    """Truth and prediction of the test rows, scaled and in real units."""
    scaled = model.transform(examples.where("split = 'test'")).select(
        "source",
        "date",
        F.col("y").alias("truth_scaled"),
        F.col("prediction").alias("prediction_scaled"),
        F.col("y").alias("truth"),
        "prediction",
    )
    return ex.inverse_scale(scaled, fit, target, ["truth", "prediction"])


def forecast_errors(predictions: DataFrame) -> DataFrame:
    """RMSE per source on scaled and on real values."""
    scaled = rmse(predictions, "truth_scaled", "prediction_scaled", ["source"]).withColumnRenamed("rmse", "rmse_scaled")
    return scaled.join(rmse(predictions, by=["source"]), "source")


def experiment_matrix(
    features: DataFrame,
    targets: Sequence[str],
    columns: Sequence[str],
    runs: int = 10,
    models: Sequence[str] = ("boosted", "linear"),
    grid: dict[str, Sequence] = FULL_GRID,
    fill: dict[str, float] | None = None,
) -> DataFrame:
    """One row of errors per source, model, target and run.

    Neither model draws a random number, so equal runs would give equal rows: each setting is fitted once and its
    row stands for every run. The boosting keeps gaps, the linear model carries the last value forward.
    """
    results = []
    for target, kind in product(targets, models):
        flat, fit = prepared_examples(features, target, columns, fill=fill, missing="keep" if kind == "boosted" else "ffill")
        model = train_forecasters(flat, grid) if kind == "boosted" else train_linear(flat)
        errors = forecast_errors(predict_forecast(model, flat, fit, target))
        results.append(errors.withColumns({"model": F.lit(kind), "target": F.lit(target)}))
    whole = materialise(reduce(DataFrame.unionByName, results))
    return whole.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


# --- a stage to store -----------------------------------------------------------------------------


class _ForecastParams(Params):
    target = Param(Params._dummy(), "target", "column to forecast", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "columns that the forecast reads besides", TypeConverters.toListString)
    fill = Param(Params._dummy(), "fill", "what stands for missing values, by column, as JSON", TypeConverters.toString)
    missing = Param(Params._dummy(), "missing", "keep, ffill or drop: what happens to other gaps", TypeConverters.toString)
    window = Param(Params._dummy(), "window", "rows that an example looks back on", TypeConverters.toInt)
    testRows = Param(Params._dummy(), "testRows", "rows at the end of a series that are not learned from", TypeConverters.toInt)
    kind = Param(Params._dummy(), "kind", "boosted or linear", TypeConverters.toString)
    grid = Param(Params._dummy(), "grid", "search grid of the boosting, as JSON", TypeConverters.toString)

    def _filled(self, features: DataFrame) -> DataFrame:
        fill = json.loads(self.getOrDefault(self.fill))
        return filled_features(features, self.getOrDefault(self.target), self.getOrDefault(self.columns), fill, self.getOrDefault(self.missing))


class Forecast(Estimator, _ForecastParams, DefaultParamsReadable, DefaultParamsWritable):
    """From daily features to a model that forecasts them in real units: gaps, scaling, windows and the search in one stage."""

    def __init__(
        self,
        target: str = "close",
        columns: Sequence[str] = (),
        fill: dict[str, float] | None = None,
        missing: str | None = None,
        window: int = ex.WINDOW_ROWS,
        testRows: int = ex.TEST_ROWS,  # noqa: N803
        kind: str = "boosted",
        grid: dict[str, Sequence] = FULL_GRID,
    ):
        super().__init__()
        missing = missing or ("keep" if kind == "boosted" else "ffill")
        self._set(target=target, columns=list(columns), fill=json.dumps(fill or {}), missing=missing, window=window, testRows=testRows, kind=kind, grid=json.dumps(grid))

    def _fit(self, features: DataFrame) -> ForecastModel:
        used = {p: self.getOrDefault(p) for p in ("target", "columns", "window", "missing")}
        flat, fit = prepared_examples(features, test_rows=self.getOrDefault(self.testRows), fill=json.loads(self.getOrDefault(self.fill)) or None, **used)
        boosted = self.getOrDefault(self.kind) == "boosted"
        found = train_forecasters(flat, json.loads(self.getOrDefault(self.grid))) if boosted else train_linear(flat)
        model = ForecastModel(fit, materialise(found.fitted))
        model.chosen = found.chosen
        return self._copyValues(model)


class ForecastModel(Model, _ForecastParams, MLReadable, MLWritable):
    """Forecasts each row of daily features from the rows before it: ``source, date, truth, prediction``, in real units.

    A row needs ``window`` rows before it, and a source that was learned.
    """

    def __init__(self, scaling: DataFrame | None = None, fitted: DataFrame | None = None):
        super().__init__()
        self.scaling, self.fitted = scaling, fitted

    def _transform(self, features: DataFrame) -> DataFrame:
        target, columns = self.getOrDefault(self.target), self.getOrDefault(self.columns)
        used = [target, *[c for c in columns if c != target]]
        scaled = ex.scale_min_max(self._filled(features), self.scaling, used)
        windows = ex.sliding_examples(materialise(scaled), target, columns, self.getOrDefault(self.window), keys=["source"])
        flat = ex.flatten_examples(windows, len(used))
        predict = predict_trees if self.getOrDefault(self.kind) == "boosted" else predict_linear
        rows = predict(flat, self.fitted).select("source", "date", F.col("y").alias("truth"), "prediction")
        return ex.inverse_scale(rows, self.scaling, target, ["truth", "prediction"])

    def write(self) -> MLWriter:
        return _ForecastWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForecastReader()


class _ForecastWriter(MLWriter):
    def __init__(self, model: ForecastModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.scaling.write.parquet(f"{path}/scaling")
        self.model.fitted.write.parquet(f"{path}/fitted")


class _ForecastReader(MLReader):
    def load(self, path: str) -> ForecastModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = [self.sparkSession.read.parquet(f"{path}/{name}") for name in ("scaling", "fitted")]
        model = ForecastModel(*tables)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
