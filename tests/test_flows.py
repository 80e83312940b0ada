"""End-to-end flows on small frames, with one source and one day holding most rows."""

import datetime as dt
import math
import struct

import pytest
from pyspark.sql import functions as F

from moodtide.functions import models
from moodtide.operators import clean, daily, learn, lexicon
from moodtide.plans import flows

TERMS = {"good": 0.5, "bad": -0.75}
DAY = dt.date(2020, 1, 1)


def posts(spark):
    rows = []
    for i in range(600):
        hot = i % 3 > 0
        title = ["good news", "bad news", "", "[deleted]"][i % 4]
        rows.append(("hot" if hot else f"s{i % 5}", i, title, "a good body" if i % 2 else None, i % 9, i % 6, 0.5 + (i % 50) / 100, DAY + dt.timedelta(0 if hot else i % 4)))
    kinds = "source string, id int, title string, selftext string, score int, num_comments int, upvote_ratio double, date date"
    return spark.createDataFrame(rows, kinds), rows


def expected(rows, share):
    """The same figures, row by row."""
    sums = {}
    for source, i, title, body, score, comments, ratio, day in rows:
        if title == "[deleted]":
            continue
        words = f"{title} {body or ''}".split()
        total = sum(TERMS.get(w, 0.0) for w in words)
        vader = total / math.sqrt(total * total + 15)
        bert = 2 / (1 + math.exp(-total)) - 1 if share else 0.0
        ratio = struct.unpack("f", struct.pack("f", ratio))[0]
        weight = 1 / (1 + math.exp(-(score / ratio + 2.316 * comments) / 10)) * (2 * ratio - 1)
        entry = sums.setdefault((source, day), [0.0, 0.0, 0.0, 0, 0])
        for k, v in enumerate((bert, vader, weight * (share * bert + (1 - share) * vader), title != "", comments)):
            entry[k] += v
    return sums


@pytest.mark.parametrize("share", [0.0, 0.3])
@pytest.mark.parametrize("parts", [1, 16])
def test_daily_features(spark, share, parts):
    frame, rows = posts(spark)
    terms = spark.createDataFrame(list(TERMS.items()), "term string, polarity double")
    load = models.bag_of_words_logit(TERMS)
    scored = flows.score_posts(frame.repartition(parts), terms, share, load, lexicon.lexicon_compound)
    metrics = spark.createDataFrame([(DAY, 10.0), (DAY + dt.timedelta(1), 0.0)], "date date, closing_price double")
    found = flows.daily_features(scored, metrics).collect()
    wanted = expected(rows, share)
    assert {(r.source, r.date) for r in found} == set(wanted)
    for r in found:
        got = [r.sia_bert_sum, r.sia_vader_sum, r.sia_sum, r.num_posts, r.num_comments]
        assert got == [pytest.approx(w, abs=1e-9) for w in wanted[r.source, r.date]]
        assert r.log_price == (pytest.approx(math.log(10)) if r.date == DAY else None)


def test_texts_can_be_kept(spark):
    frame, _ = posts(spark)
    terms = spark.createDataFrame(list(TERMS.items()), "term string, polarity double")
    narrow = flows.score_posts(frame, terms)
    full = flows.score_posts(frame, terms, keep_text=True)
    assert {"text", "selftext", "title"} <= set(full.columns) and "text" not in narrow.columns
    assert sorted(full.select(*narrow.columns).collect()) == sorted(narrow.collect())


def test_chat_has_constant_weight(spark):
    rows = spark.createDataFrame([("c", 1, "2020-01-01T23:00:00", '["good ",{"type":"b","text":"bad"}]'), ("c", 2, "2020-01-01T01:00:00", None)], "source string, id bigint, date string, j string")
    chat = flows.chat_posts(rows.withColumn("text", F.parse_json("j")).drop("j"))
    terms = spark.createDataFrame(list(TERMS.items()), "term string, polarity double")
    found = daily.daily_sentiment(flows.score_posts(chat, terms, limit=None), F.col("has_title")).head()
    assert found.sia_sum == pytest.approx(0.52497918747894 * found.sia_vader_sum)
    assert found.sia_vader_sum == pytest.approx(0.12803687993289598) and (found.num_posts, found.num_comments) == (1, 0)


def test_daily_sums_skip_missing_values(spark):
    rows = [("s", DAY, None, float("nan"), 1.0, "t", None), ("s", DAY, 1.0, 2.0, None, None, 3), ("s", None, 9.0, 9.0, 9.0, "t", 9)]
    frame = spark.createDataFrame(rows, "source string, date date, sia_bert double, sia_vader double, sia double, title string, num_comments int")
    assert tuple(daily.daily_sentiment(frame).head())[2:] == (1.0, 2.0, 1.0, 1, 3)


def test_computed_indicators_replace_others(spark):
    features = spark.createDataFrame([("s", DAY, 1.0, 2.0)], "source string, date date, macd double, other double")
    prices = spark.createDataFrame([("p", DAY, 5.0, 6.0)], "series_id string, date date, close double, macd double")
    found = daily.join_prices(features, prices).head().asDict()
    assert found == {"source": "s", "date": DAY, "other": 2.0, "close": 5.0, "macd": 6.0}


def test_prices_of_several_series_never_double_a_row(spark):
    features = spark.createDataFrame([("s", DAY, 1.0)], "source string, date date, other double")
    prices = spark.createDataFrame([("p", DAY, 5.0), ("q", DAY, 6.0)], "series_id string, date date, close double")
    with pytest.raises(ValueError, match="several series"):
        daily.join_prices(features, prices)
    assert [r.close for r in daily.join_prices(features, prices, "q").collect()] == [6.0]
    own = features.withColumn("series_id", F.explode(F.array(F.lit("p"), F.lit("q"), F.lit("r"))))
    assert {r.series_id: r.close for r in daily.join_prices(own, prices).collect()} == {"p": 5.0, "q": 6.0, "r": None}


def test_union_and_features(spark):
    a = spark.createDataFrame([("s", 1, 2.0)], "source string, id int, v double")
    b = spark.createDataFrame([(2, "t")], "id int, source string")
    assert sorted(tuple(r) for r in clean.union_sources(a, b, a).select("source", "id", "v").collect()) == [("s", 1, 2.0), ("s", 1, 2.0), ("t", 2, None)]


def test_files_to_daily_features(spark, tmp_path):
    """The example of the README: a post fetched twice counts once, with its typed engagement."""
    from moodtide.sources import readers

    head = "id,url,title,score,num_comments,created_utc,selftext,upvote_ratio\n"
    rows = "a,u,good,3,9,1577836800,,1.0\na,u,good,3,10,1577836800,,1.0\nb,u,[removed],3,10,1577836800,,1.0\nc,u,x,1,1,,,1\n"
    (tmp_path / "x-submissions.csv").write_text(head + rows)
    (tmp_path / "lexicon.csv").write_text("term,polarity\ngood,0.5\n")
    (tmp_path / "metrics.csv").write_text("Time,BTC / Closing Price\n2020-01-01,1.0\n")
    posts = clean.cast_defaults(clean.epoch_to_date(readers.read_posts(spark, str(tmp_path), source="forum")))
    scored = flows.score_posts(clean.dedupe_posts(posts), readers.load_lexicon(spark, str(tmp_path / "lexicon.csv")))
    (found,) = flows.daily_features(scored, readers.read_indicators(spark, str(tmp_path / "metrics.csv"))).collect()
    assert (found.source, found.date, found.num_posts, found.num_comments, found.log_price) == ("forum", DAY, 1, 10, 0.0)
    assert found.sia_vader_sum == pytest.approx(0.12803687993289598)


def test_posts_are_scored_by_the_trained_classifier(spark, tmp_path):
    rows = [(i, t, y) for i, (t, y) in enumerate([("good fine great", 1), ("bad awful poor", 0)] * 20)]
    train = spark.createDataFrame(rows, "doc_id int, text string, label int")
    model, _ = learn.train_text_classifier(train, train, ["doc_id"], epochs=2, rate=0.1)
    learn.save_classifier(model, str(tmp_path / "m"))
    frame, _ = posts(spark)
    terms = spark.createDataFrame(list(TERMS.items()), "term string, polarity double")
    scored = flows.score_posts(frame, terms, 0.4, learn.load_classifier(str(tmp_path / "m")))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    found = {r.id: r.sia_bert for r in scored.collect()}
    assert found[4] > 0.1 > abs(found[1])  # good alone; good and bad
