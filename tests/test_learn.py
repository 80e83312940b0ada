"""Text classifiers against plain loops, and what is stored of them."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from moodtide.functions import models
from moodtide.operators import learn
from moodtide.plans import artefacts

SF = "/root/testdata/sf0.001"


def texts(spark, n=200, seed=2):
    draw, rows = random.Random(seed), []
    for i in range(n):
        label = i % 3 == 0
        words = draw.choices(["good", "fine", "great"] if label else ["bad", "poor"], k=2) + draw.choices("abcdefg", k=4)
        rows.append((i, " ".join(words), int(label)))
    rows += [(n, "", 1), (n + 1, "unseen words only", 0)]
    return spark.createDataFrame(rows, "id int, text string, label int"), rows


def test_epochs_go_on_from_the_last_weights(spark):
    train, rows = texts(spark)
    train = train.repartition(5)
    steps, buckets, rate = 4, 64, 0.05
    model, history = learn.train_text_classifier(train, train, ["id"], epochs=3, buckets=buckets, steps=steps, rate=rate)
    front = model.stages[:-1]
    frame = train
    for stage in front:
        frame = stage.transform(frame)
    data = frame.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(steps))).collect()
    x = np.array([r["_weights"].toArray() for r in data])
    y, part = np.array([r.label for r in data]), np.array([r.part for r in data])
    w, m, v, t, losses = np.zeros(buckets + 1), 0.0, 0.0, 0, []
    for _ in range(3):
        total = 0.0
        for number in range(steps):
            z = x[part == number] @ w[:-1] + w[-1]
            off = 1 / (1 + np.exp(-z)) - y[part == number]
            total += np.log1p(np.exp(-np.where(y[part == number] == 1, z, -z))).sum()
            g = np.append(x[part == number].T @ off, off.sum()) / len(z)
            t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(total / len(y))
    found = history.orderBy("epoch").collect()
    assert [r.train_loss for r in found] == pytest.approx(losses)
    assert losses == sorted(losses, reverse=True)
    one = learn.train_text_classifier(train, train, ["id"], epochs=1, buckets=buckets, steps=steps, rate=rate)[1].head()
    assert (one.accuracy, one.train_loss) == (found[0].accuracy, pytest.approx(found[0].train_loss))
    best = max(found, key=lambda r: (r.accuracy, -r.epoch))
    if best.epoch == 2:
        assert model.stages[-1].coefficients.toArray() == pytest.approx(w[:-1])
    right = learn.classifier_probability(model, train).select(F.avg(((F.col("probability") > 0.5).cast("int") == F.col("label")).cast("int"))).head()[0]
    assert right > 0.9


def test_word_classifier_is_naive_bayes(spark, tmp_path):
    train, rows = texts(spark)
    model = learn.train_word_classifier(train, min_documents=3)
    learn.save_classifier(model, str(tmp_path / "m"))
    counts, documents = [{}, {}], {}
    for _, text, label in rows:
        words = [w for w in re.split(r"[^\w']+", text.lower()) if w]
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
        for w in set(words):
            documents[w] = documents.get(w, 0) + 1
    known = [w for w, n in documents.items() if n >= 3]
    sizes = [sum(c.get(w, 0) for w in known) + len(known) for c in counts]
    prior = math.log(sum(r[2] for r in rows) + 1) - math.log(sum(1 - r[2] for r in rows) + 1)
    weight = {w: math.log((counts[1].get(w, 0) + 1) / sizes[1]) - math.log((counts[0].get(w, 0) + 1) / sizes[0]) for w in known}
    scored = learn.classifier_probability(learn.load_classifier(str(tmp_path / "m")), train)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    for r in scored.collect():
        z = prior + sum(weight.get(w, 0.0) for w in re.split(r"[^\w']+", r.text.lower()))
        assert r.probability == pytest.approx(1 / (1 + math.exp(-z)))


def test_word_classifier_reads_the_texts_once_and_equals_the_estimators(spark, monkeypatch):
    words = ["Good", "bad\u00e9", "it's", "\u01c5x", "\u0660\u0661", "--", "A_b", "\u2003z", "\u0130s", "x1"]
    rows = [(" ".join(words[(i * k) % len(words)] for k in range(i % 9)) if i % 11 else None, i % 3 % 2 if i % 7 else None) for i in range(200)]
    train = spark.createDataFrame(rows, "text string, label int")
    read = spark.sparkContext.accumulator(0)
    counted = train.rdd.map(lambda r: (read.add(1), tuple(r))[1] if r.text is not None else tuple(r)).toDF(train.schema)
    monkeypatch.setattr(learn, "COUNTED_TEXTS", 4, raising=False)
    model = learn.train_word_classifier(counted, min_documents=2)
    assert read.value <= 2 * sum(t is not None for t, _ in rows)  # once for the words, once for the labels alone
    plain = train.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label")).na.drop()
    stages = [learn._words(), CountVectorizer(inputCol="_words", outputCol="_counts", minDF=2), NaiveBayes(featuresCol="_counts", labelCol="label")]
    expected = Pipeline(stages=stages).fit(plain)
    assert sorted(model.stages[1].vocabulary) == sorted(expected.stages[1].vocabulary)
    both = [sorted((r.text or "", r.probability) for r in learn.classifier_probability(m, plain).collect()) for m in (model, expected)]
    assert both[0] == [(t, pytest.approx(p, abs=1e-12)) for t, p in both[1]]
    with pytest.raises(ValueError, match="no word"):
        learn.train_word_classifier(train, min_documents=1000)


def test_predictor_equals_a_loop():
    weights = {"good": 1.5, "bad": -2.0}
    given = ["good  Bad\tgood", "", None, "x " * 600 + "good", "\n good", "bad" * 3, " "]
    predict = models.bag_of_words_logit(weights, bias=0.25, max_tokens=500)()
    expected = [0.25 + sum(weights.get(t, 0.0) for t in (x or "").lower().split()[:500]) for x in given]
    assert predict(np.array(given, dtype=object)).tolist() == pytest.approx([1 / (1 + math.exp(-z)) for z in expected])


def test_artefacts_are_stored_once(spark):
    paths = [artefacts.stored(spark, SF, "probe", lambda p: spark.range(3).write.parquet(p)) for _ in range(2)]
    assert paths[0] == paths[1] and spark.read.parquet(paths[0]).count() == 3


def test_flow_has_no_python(spark):
    import __spark_entry__ as entry

    for name in ("join_indicators", "chat_daily_features"):
        assert "Python" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
