"""Text classifiers: scoring by any predictor, training, storing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from moodtide.functions import scores
from moodtide.operators.stats import batch_metrics, select_best
from moodtide.session import materialise, scratch_path, with_global_position

#: What stands between the words that a classifier reads.
WORD_GAP = r"[^\p{L}\p{N}']+"
#: Texts whose words a task counts at once.
COUNTED_TEXTS = 2048


def score_with_model(
    df: DataFrame, load: Callable[[], Callable], text: str = "text", out: str = "probability", batch_size: int = 512
) -> DataFrame:
    """Probability of a positive text by any batch predictor; ``load`` runs once per Python worker."""
    predict = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size)
    return df.withColumn(out, predict(F.col(text)))


def _words() -> RegexTokenizer:
    return RegexTokenizer(inputCol="text", outputCol="_words", pattern=WORD_GAP, minTokenLength=1)


def train_word_classifier(train: DataFrame, min_documents: int = 5, most_words: int = 1 << 18, smoothing: float = 1.0) -> PipelineModel:
    """A pipeline that tells ``label`` 1 from 0 by the words of ``text``: naive Bayes over their counts.

    Words of ``min_documents`` training texts at least count, the ``most_words`` most frequent ones of them. The texts are split
    once, for the words and for their counts by label, which are all that naive Bayes needs.
    """
    spark = train.sparkSession
    rows = train.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label")).na.drop()
    texts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy("label").collect()}  # a row a label
    known = _word_counts(rows, list(texts)).where(F.col("texts") >= min_documents)
    known = known.orderBy(F.col("n").desc(), "word").limit(most_words).toArrow()
    if not known.num_rows:
        raise ValueError(f"no word stands in {min_documents} training texts")
    words = CountVectorizer(inputCol="_words", outputCol="_counts").fit(spark.createDataFrame([(["_"],)], "_words array<string>"))
    counter = _with_stored(words, [(known.column("word").to_pylist(),)])
    found = np.stack([known.column(f"n{i}").to_numpy() for i in range(len(texts))]) + smoothing
    theta = np.log(found) - np.log(found.sum(axis=1, keepdims=True))
    each = np.array(list(texts.values())) + smoothing
    prior = Vectors.dense(np.log(each) - np.log(each.sum()))
    pattern = spark.createDataFrame([(0.0, Vectors.dense([0.0])), (1.0, Vectors.dense([1.0]))], ["label", "_counts"])
    bayes = NaiveBayes(featuresCol="_counts", labelCol="label", smoothing=smoothing).fit(pattern)
    learned = _with_stored(bayes, [(prior, DenseMatrix(*theta.shape, theta.ravel(), True), DenseMatrix(0, 0, []))])
    return PipelineModel(stages=[_words(), counter, learned])


def _word_counts(rows: DataFrame, labels: list[float]) -> DataFrame:
    """``word``, its ``texts``, its number ``n`` and its number in the texts of each label, ``n0`` and so on.

    Spark makes the small letters and the gaps, a task counts the words of ``COUNTED_TEXTS`` texts at once, and Spark adds up.
    """
    numbers = [f"n{i}" for i in range(len(labels))]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_TEXTS):
                part = batch.slice(at, COUNTED_TEXTS)
                split = pc.split_pattern(part.column("text"), " ")
                words = split.flatten().dictionary_encode()
                size, place, row = len(words.dictionary), words.indices.to_numpy(), pc.list_parent_indices(split).to_numpy()
                label = part.column("label").to_numpy()[row]
                once = np.unique(row.astype(np.int64) * size + place) % size
                counts = [np.bincount(x, minlength=size) for x in (once, *[place[label == y] for y in labels])]
                yield pa.RecordBatch.from_arrays([words.dictionary, *map(pa.array, counts)], ["word", "texts", *numbers])

    spaced = rows.select(F.regexp_replace(F.lower("text"), WORD_GAP, " ").alias("text"), "label")
    schema = ", ".join(["word string", *[f"{c} long" for c in ("texts", *numbers)]])
    found = spaced.mapInArrow(counted, schema).where("word <> ''")
    sums = found.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("texts", *numbers)])
    return sums.withColumn("n", reduce(add, [F.col(c) for c in numbers], F.lit(0)))


def _with_stored(model, rows: list[tuple]):
    """``model`` with ``rows`` for its learned values, by way of its stored form."""
    spark = SparkSession.active()
    path = scratch_path(spark, "learned")
    model.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return type(model).load(path)


@dataclass
class _Steps:
    """Adam's state; weights of all buckets and, last, the intercept."""

    weights: np.ndarray
    rate: float
    first: np.ndarray = 0.0
    second: np.ndarray = 0.0
    taken: int = 0

    def take(self, gradient: np.ndarray) -> None:
        self.taken += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        mean, spread = self.first / (1 - 0.9**self.taken), self.second / (1 - 0.999**self.taken)
        self.weights -= self.rate * mean / (np.sqrt(spread) + 1e-8)


def _logits(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The logit of each row's sparse vector, and all places, values and rows of the vectors."""
    vectors = batch.column("_weights")
    places, values = vectors.field("indices"), vectors.field("values")
    row = pc.list_parent_indices(places).to_numpy()
    at, x = places.flatten().to_numpy(), values.flatten().to_numpy()
    return weights[-1] + np.bincount(row, weights[at] * x, batch.num_rows), at, x, row


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int, float]:
    """The sum of the gradients over ``rows``, their number and the sum of their losses.

    Every task adds up its own rows, the sums of a place meet in one shuffle, and as many numbers as there are weights reach
    the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        total, count, loss = np.zeros(size), 0, 0.0
        for batch in batches:
            z, at, x, row = _logits(batch, shared.value)
            y = batch.column("label").to_numpy()
            off = 1.0 / (1.0 + np.exp(-z)) - y
            total[:-1] += np.bincount(at, x * off[row], size - 1)
            total[-1] += off.sum()
            count += len(y)
            loss += float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
        used = np.flatnonzero(total)
        # the number of rows and their loss travel at places behind the weights
        places = np.concatenate([used, [size, size + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.concatenate([total[used], [count, loss]]))], ["place", "part"])

    found = rows.mapInArrow(summed, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).toArrow()
    sums = np.zeros(len(weights) + 2)
    sums[found.column("place").to_numpy()] = found.column("part").to_numpy()
    shared.unpersist()
    return sums[:-2], int(sums[-2]), float(sums[-1])


def _logistic_model(spark: SparkSession, weights: np.ndarray) -> LogisticRegressionModel:
    """Spark's own model with the given weights, by way of its stored form."""
    size = len(weights) - 1
    pattern = spark.createDataFrame([(0.0, Vectors.sparse(size, [], [])), (1.0, Vectors.sparse(size, [0], [1.0]))], ["label", "_weights"])
    path = scratch_path(spark, "weights")
    LogisticRegression(featuresCol="_weights", maxIter=1).fit(pattern).write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    row = (2, size, Vectors.dense([weights[-1]]), DenseMatrix(1, size, weights[:-1], True), False)
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/data")
    return LogisticRegressionModel.load(path)


def train_text_classifier(
    train: DataFrame,
    valid: DataFrame,
    order: Sequence[str],
    epochs: int = 3,
    buckets: int = 1 << 18,
    batch_size: int = 32,
    steps: int = 8,
    rate: float = 0.01,
) -> tuple[PipelineModel, DataFrame]:
    """Fit a logistic classifier of ``text`` against ``label`` by passes over the training rows, and keep the best epoch.

    An epoch takes ``steps`` gradient steps (Adam), each over its own part of the rows, dealt out by a hash of ``order``, and goes
    on from the weights of the epoch before. Returns the fitted pipeline and ``(epoch, accuracy, loss, train_loss)``:
    accuracy and summed batch loss on the validation rows, and the mean loss of the training rows as they were met. A later
    epoch must be strictly more accurate to replace an earlier one.
    """
    spark = train.sparkSession
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets)
    idf = IDF(inputCol="_counts", outputCol="_weights")
    front = Pipeline(stages=[_words(), hashed, idf]).fit(train)
    part = F.pmod(F.xxhash64(*order), F.lit(steps)).cast("int").alias("part")
    path = scratch_path(spark, "training-rows")
    front.transform(train).select(part, "_weights", F.col("label").cast("double").alias("label")).write.partitionBy("part").parquet(path)
    ready = spark.read.parquet(path)
    checked = with_global_position(front.transform(valid).select(*order, "_weights", "label"), list(order))
    checked = materialise(checked.select("position", "_weights", F.col("label").cast("double").alias("label")))  # numbered once for all epochs

    state, kept, history = _Steps(np.zeros(buckets + 1), rate), [], []
    for epoch in range(epochs):
        losses, rows = 0.0, 0
        for number in range(steps):
            gradient, count, loss = _gradient(ready.where(F.col("part") == number).select("_weights", "label"), state.weights)
            if count:
                state.take(gradient / count)
            losses, rows = losses + loss, rows + count
        kept.append(state.weights.copy())
        result = batch_metrics(_scored(checked, kept[-1]), order, batch_size=batch_size, position="position").head()
        history.append((epoch, result.accuracy, result.loss, losses / max(1, rows)))
    table = spark.createDataFrame(history, "epoch int, accuracy double, loss double, train_loss double")
    best = select_best(table, "accuracy", "epoch").head()
    return PipelineModel(stages=[*front.stages, _logistic_model(spark, kept[best.epoch])]), table


def _scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("position"), pa.array(_logits(batch, shared.value)[0]), batch.column("label")]
            yield pa.RecordBatch.from_arrays(columns, ["position", "logit", "label"])

    return rows.mapInArrow(each, "position long, logit double, label double")


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classifier_probability(model: PipelineModel, df: DataFrame, out: str = "probability") -> DataFrame:
    """Probability of a positive text by a fitted pipeline; row-local, so it serves streams too."""
    scored = model.transform(df)
    return scored.withColumn("_p", vector_to_array("probability")[1]).select(*df.columns, F.col("_p").alias(out))


def classify_label(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Add ``sentiment`` and ``percentage``."""
    p = F.col(probability)
    return df.withColumns({"sentiment": scores.classify_sentiment(p), "percentage": scores.classify_percentage(p)})
