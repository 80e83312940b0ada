"""Queries: learning jobs and streams. The numbers a learner finds have no SQL; what the jobs promise has."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.operators import daily, forecast, learn, lexicon, series
from moodtide.operators import examples as ex
from moodtide.plans import artefacts
from moodtide.plans import fixtures as fx
from moodtide.plans.post_queries import DAILY_CTE, compound_cte, scored_posts
from moodtide.plans.registry import query
from moodtide.plans.rules_sql import classifier_cte
from moodtide.plans.series_sql import INDICATED_CTE
from moodtide.session import materialise, scratch_path
from moodtide.sources import readers, writers
from moodtide.streaming import score as stream

#: What the forecast reads besides its target: sentiment, engagement, market metrics, price indicators.
FEATURES = ("sia_sum", "num_posts", "num_comments", "active_addr_cnt", "nvt", "tx_cnt", "macd", "signal", "ema", "rsi", "volume")
#: A day without posts has no sentiment and no comments.
FILL = {"sia_sum": 0.0, "num_posts": 0, "num_comments": 0}
#: Posts and events of the test tables are dealt out to the days of the price series, so that the two meet.
FIRST_DAY, DAYS = "1995-01-01", 2400


def _day(number: str) -> F.Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col(number) % DAYS).cast("int"))


def _market(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.table(spark, sf, "events").select(_day("event_id").alias("date"), "user_id", "value")
    count = F.count(F.lit(1))
    return events.groupBy("date").agg(
        F.count_distinct("user_id").alias("active_addr_cnt"), F.round(F.sum("value") / count, 6).alias("nvt"), count.alias("tx_cnt")
    )


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Daily sentiment, market metrics and price indicators beside the price: the columns the forecast learns from."""
    posts = fx.posts(spark, sf).withColumn("date", _day("id"))
    sentiment = daily.daily_sentiment(scored_posts(spark, sf, posts).withColumn("source", F.lit("orders")), F.col("has_title"))
    prices = series.price_indicators(fx.prices(spark, sf).select("series_id", "date", "close", "volume"))
    joined = prices.withColumnRenamed("series_id", "source").join(sentiment.drop("sia_bert_sum", "sia_vader_sum"), ["source", "date"], "left")
    return daily.join_indicators(joined, _market(spark, sf)).select("source", "date", "close", *FEATURES)


DATED_DAILY = DAILY_CTE.replace("cast(e.ts as date) as date", f"cast(date '{FIRST_DAY}' + cast(d.doc_id % {DAYS} as int) as date) as date")
MATRIX_CTE = f"""{DATED_DAILY}, {INDICATED_CTE},
    sentiment as (
      select date, sum(sia_sum) as sia_sum, sum(num_posts)::bigint as num_posts, sum(num_comments)::bigint as num_comments
      from daily group by date),
    market as (
      select cast(date '{FIRST_DAY}' + cast(event_id % {DAYS} as int) as date) as date, count(distinct user_id) as active_addr_cnt,
             round(sum(value) / count(*), 6) as nvt, count(*) as tx_cnt from events group by 1),
    matrix as (
      select series_id as source, i.date, close, coalesce(sia_sum, 0) as sia_sum, coalesce(num_posts, 0) as num_posts,
             coalesce(num_comments, 0) as num_comments, active_addr_cnt, nvt, tx_cnt, macd, signal, ema, rsi, volume
      from indicated i left join sentiment s on s.date = i.date left join market m on m.date = i.date),
    complete as (select * from matrix where active_addr_cnt is not null and macd is not null and signal is not null
                 and ema is not null and rsi is not null and close is not null)"""
ROUNDED = {"sia_sum": 5, "nvt": 5, "macd": 3, "signal": 3, "ema": 3, "rsi": 6}


@query(
    "feature_matrix",
    f"with {MATRIX_CTE} select source, date, close, "
    + ", ".join(f"round({c}, {ROUNDED[c]}) + 0.0 as {c}" if c in ROUNDED else c for c in FEATURES)
    + " from matrix",
)
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve columns of the forecast, one row per day of the price series."""
    rows = _features(spark, sf).fillna(FILL)
    return rows.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in ROUNDED.items()})


@query(
    "missing_report",
    f"""with {MATRIX_CTE} select source, count(*) as rows, (select count(*) from complete) as complete,
    count(*) filter (active_addr_cnt is null) as without_active_addr_cnt, count(*) filter (rsi is null) as without_rsi
    from matrix group by source""",
)
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the forecast leaves out, and why."""
    report = forecast.missing_report(_features(spark, sf).fillna(FILL), ["close", *FEATURES])
    return report.select("source", "rows", "complete", "without_active_addr_cnt", "without_rsi")


EXAMPLES_CTE = f"""{MATRIX_CTE},
    halves as (
      select *, case when row_number() over (partition by source order by date desc) <= 60 then 'test' else 'train' end as split,
             close + {" + ".join(FEATURES)} as total from complete),
    windowed as (
      select source, split, date, close as y, count(*) over back as n, sum(total) over back as total
      from halves window back as (partition by source, split order by date rows between 30 preceding and 1 preceding))"""


@query(
    "matrix_examples",
    f"with {EXAMPLES_CTE} select source, split, date, y, 360 as n_values, round(total, 1) as total from windowed where n = 30",
)
def matrix_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of 30 days by 12 columns, unscaled so that SQL can add them up."""
    complete = _features(spark, sf).fillna(FILL).na.drop()
    windows = ex.sliding_examples(ex.chronological_split(complete), "close", FEATURES)
    flat = windows.select("source", "split", "date", "y", ex.flat_values(F.col("x"), 1 + len(FEATURES)).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    return flat.select("source", "split", "date", "y", F.size("v").alias("n_values"), F.round(total, 1).alias("total"))


@query(
    "carry_forward",
    f"""with {MATRIX_CTE} select source, date,
    """
    + ", ".join(f"last_value({c} ignore nulls) over past as {c}" for c in ("active_addr_cnt", "tx_cnt"))
    + """, round(last_value(nvt ignore nulls) over past, 5) + 0.0 as nvt
    from matrix window past as (partition by source order by date rows unbounded preceding)""",
)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Market metrics of every day of the price series, those of the last day that has some where a day has none."""
    gaps = ["active_addr_cnt", "tx_cnt", "nvt"]
    rows = series.carry_forward(materialise(_features(spark, sf).select("source", "date", *gaps)), gaps, ["source"])
    return rows.withColumn("nvt", F.round("nvt", 5) + F.lit(0.0))


def _trained(spark: SparkSession, sf: str):
    flat, fit = forecast.prepared_examples(_features(spark, sf), "close", FEATURES, fill=FILL)
    return forecast.train_forecasters(flat), flat, fit


CANDIDATES = ", ".join(f"({i}, {depth}, {trees}, {step}::double)" for i, depth, trees, step in forecast.candidates(forecast.FULL_GRID))


@query("grid_scores", f"""select 'orders' as source, *, true as scored from (values {CANDIDATES}) as g(candidate, "maxDepth", "maxIter", "stepSize")""")
def grid_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate of the full grid with a score below 1; deeper or longer boostings score otherwise than a single split."""
    scores = _trained(spark, sf)[0].scores
    others = W.partitionBy("source")
    first = F.min_by("mean_score", "candidate").over(others)
    scored = (F.col("mean_score") < 1) & ((F.col("candidate") == 0) | (F.col("mean_score") != first))
    return scores.select("source", "candidate", "maxDepth", "maxIter", "stepSize", scored.alias("scored"))


@query("train_forecaster", "select 'orders' as source, true as in_grid, true as is_best, true as has_its_trees")
def train_forecaster(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen parameter set is a candidate, none has a better score, and the fitted model has its number and depth of trees."""
    model = _trained(spark, sf)[0]
    best = model.chosen.select("source", "candidate", "maxIter", F.col("mean_score").alias("chosen_score"))
    trees = model.fitted.groupBy("source").agg((F.max("tree") + 1).alias("trees"))
    rows = model.scores.drop("maxIter").join(best, ["source", "candidate"], "left").groupBy("source")
    found = rows.agg(
        F.max("chosen_score").isNotNull().alias("in_grid"), (F.max("chosen_score") == F.max("mean_score")).alias("is_best"), F.max("maxIter").alias("maxIter")
    )
    return found.join(trees, "source").select("source", "in_grid", "is_best", (F.col("trees") == F.col("maxIter")).alias("has_its_trees"))


def _last_days(more: str) -> str:
    """SQL of the 30 days that are predicted."""
    return f"with {MATRIX_CTE} select source, date, {more} from matrix where close is not null order by date desc limit 30"


@query("predict_forecast", _last_days("round(close, 2) as truth, true as predicted"))
def predict_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Truth of the 30 last days in real units, each with a prediction inside the range of the prices that were learned from."""
    model, flat, fit = _trained(spark, sf)
    rows = forecast.predict_forecast(model, flat, fit, "close")
    rows = rows.join(fit.select("source", "close_min", "close_max"), "source")
    inside = F.col("prediction").between(F.col("close_min"), F.col("close_max"))
    return rows.select("source", "date", F.round("truth", 2).alias("truth"), inside.alias("predicted"))


TODAY_CTE = """last_days as (
      select source, date, close, lag(close) over (partition by source order by date) as before from matrix where close is not null
      qualify row_number() over (partition by source order by date desc) <= 30)"""


@query(
    "forecast_errors",
    f"with {MATRIX_CTE}, {TODAY_CTE} select source, round(sqrt(avg(pow(close - before, 2))), 2) as of_today, true as better from last_days group by source",
)
def forecast_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The error of the linear forecast is below that of saying that tomorrow equals today, which SQL computes."""
    features = materialise(_features(spark, sf))
    flat, fit = forecast.prepared_examples(features, "close", FEATURES, fill=FILL, missing="ffill")
    rows = forecast.predict_forecast(forecast.train_linear(flat), flat, fit, "close")
    before = features.select("source", "date", F.lag("close").over(W.partitionBy("source").orderBy("date")).alias("before"))
    both = rows.join(before, ["source", "date"]).groupBy("source")
    found = both.agg(
        F.sqrt(F.avg(F.pow(F.col("truth") - F.col("before"), F.lit(2)))).alias("of_today"),
        F.sqrt(F.avg(F.pow(F.col("truth") - F.col("prediction"), F.lit(2)))).alias("error"),
    )
    return found.select("source", F.round("of_today", 2).alias("of_today"), (F.col("error") < F.col("of_today")).alias("better"))


@query("write_predictions", _last_days("round(close, 2) as truth, 'boosted' as model, 'close' as target, true as as_computed"))
def write_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored predictions equal the computed ones, and another target written later leaves them alone."""
    path = scratch_path(spark, "predictions")
    model, flat, fit = _trained(spark, sf)
    rows = materialise(forecast.predict_forecast(model, flat, fit, "close"))
    for target in ("close", "other"):
        writers.write_predictions(rows, path, "boosted", target)
    stored = readers.read_predictions(spark, path).where("target = 'close'")
    both = stored.join(rows.select("source", "date", F.col("prediction").alias("computed")), ["source", "date"])
    same = (F.col("prediction") == F.col("computed")).alias("as_computed")
    return both.select("source", "date", F.round("truth", 2).alias("truth"), "model", "target", same)


@query("save_load_model", _last_days("round(close, 2) as truth, true as as_fitted"))
def save_load_model(spark: SparkSession, sf: str) -> DataFrame:
    """A stored and reloaded pipeline forecasts the last days from raw features, in real units, like the fitted one."""
    features = materialise(_features(spark, sf))
    path = scratch_path(spark, "forecast-pipeline")
    fitted = Pipeline(stages=[forecast.Forecast("close", FEATURES, FILL)]).fit(features)
    fitted.write().save(path)
    computed = fitted.transform(features).select("source", "date", F.col("prediction").alias("fitted"))
    reloaded = ex.tail_n(PipelineModel.load(path).transform(features), 30)
    same = F.col("fitted") == F.col("prediction")
    return reloaded.join(computed, ["source", "date"]).select("source", "date", F.round("truth", 2).alias("truth"), same.alias("as_fitted"))


@query(
    "experiment_matrix",
    """select 'orders' as source, model, target, run::int as run, true as measured
    from (values ('boosted'), ('linear')) as m(model), (values ('close'), ('log_price')) as t(target), range(10) as r(run)""",
)
def experiment_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Two models, two targets, ten runs: every error is above 0 and below the range of the target."""
    features = materialise(_features(spark, sf).withColumn("log_price", F.ln("close")))
    errors = forecast.experiment_matrix(features, ["close", "log_price"], FEATURES, fill=FILL)
    measured = (F.col("rmse") > 0) & (F.col("rmse_scaled") < 1)
    return errors.select("source", "model", "target", "run", measured.alias("measured"))


def _labelled_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents; every fifth source serves for validation."""
    documents = fx.documents(spark, sf).select("doc_id", "source", "text")
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = documents.join(labels, "doc_id")
    held = F.pmod(F.xxhash64("source"), F.lit(5)) == 0
    return rows.where(~held), rows.where(held)


@query(
    "train_text_classifier",
    "select epoch::int as epoch, true as measured, true as learns from range(3) as e(epoch)",
)
def train_text_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """One row per epoch: its figures are in range, and the loss of the training rows falls from epoch to epoch."""
    train, valid = _labelled_split(spark, sf)
    _, history = learn.train_text_classifier(train, valid, ["doc_id"])
    before = F.lag("train_loss").over(W.orderBy("epoch"))  # a row an epoch
    falls = F.coalesce(F.col("train_loss") < before, F.col("train_loss") > 0)
    return history.select("epoch", (F.col("accuracy").between(0, 1) & (F.col("loss") >= 0)).alias("measured"), falls.alias("learns"))


@query(
    "train_word_classifier",
    f"""with texts as (select 'd' as source, doc_id as id, text from documents join labels using (doc_id)), {classifier_cte("texts")}
    select count(*) as texts, round(avg(cast(cast(p > 0.5 as int) = quality as int)), 6) as accuracy,
           avg(cast(cast(p > 0.5 as int) = quality as int)) > greatest(avg(quality), 1 - avg(quality)) as better_than_majority
    from classified join labels on doc_id = id""",
)
def train_word_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the stored and loaded word classifier on the texts it has learned from, against the larger class."""
    rows = learn.classifier_probability(artefacts.word_classifier(spark, sf), fx.labelled(spark, sf))
    right, good = F.avg(((F.col("probability") > 0.5).cast("int") == F.col("label")).cast("int")), F.avg("label")
    return rows.agg(
        F.count(F.lit(1)).alias("texts"), F.round(right, 6).alias("accuracy"), (right > F.greatest(good, 1 - good)).alias("better_than_majority")
    )


@query("classify_stream", "select doc_id as id, true as as_batch from documents")
def classify_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The trained classifier, stored and loaded, labels a stream of all documents as it labels the batch."""
    arriving, out, state, path = (scratch_path(spark, label) for label in ("arriving", "labelled-stream", "stream-state", "classifier"))
    learn.save_classifier(learn.train_text_classifier(*_labelled_split(spark, sf), ["doc_id"])[0], path)
    model = learn.load_classifier(path)
    documents = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    documents.write.parquet(arriving)
    texts = stream.read_text_stream(spark, arriving, "id bigint, text string")
    classify = lambda df: learn.classifier_probability(model, df)
    stream.stream_classify(texts, classify, out, state).awaitTermination()
    batch = learn.classify_label(classify(documents)).select("id", F.col("sentiment").alias("s"), F.col("percentage").alias("p"))
    same = F.col("sentiment").eqNullSafe(F.col("s")) & F.col("percentage").eqNullSafe(F.col("p"))
    return spark.read.parquet(out).join(batch, "id").select("id", same.alias("as_batch"))


def _lexicon_probability(terms: DataFrame):
    def score(batch: DataFrame) -> DataFrame:
        scored = lexicon.lexicon_compound(batch, terms, carry=[], out="compound")
        return scored.select("source", "id", F.round((F.col("compound") + 1) / 2, 6).alias("probability"))

    return score


P = "round((sia_vader + 1) / 2, 6)"


@query(
    "stream_score",
    f"""with {fx.LEXICON_CTE}, texts as (select source, doc_id as id, text from documents), {compound_cte("texts", "text")}
    select source, id, case when {P} > 0.5 then 'Positive' else 'Negative' end as sentiment,
           cast(trunc(case when {P} > 0.5 then {P} * 100 else 100 - {P} * 100 end) as int) as percentage from compound""",
)
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as a stream of files, scored in micro-batches and read back."""
    arriving, out, state = (scratch_path(spark, label) for label in ("arriving", "scored-stream", "stream-state"))
    documents = fx.table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), "text")
    documents.write.parquet(arriving)
    texts = stream.read_text_stream(spark, arriving, "source string, id bigint, text string")
    stream.stream_score(texts, _lexicon_probability(fx.lexicon(spark)), out, state).awaitTermination()
    return spark.read.parquet(out).select("source", "id", "sentiment", "percentage")
