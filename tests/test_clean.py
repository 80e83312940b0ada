import datetime as dt

from pyspark.sql import functions as F

from moodtide.functions import text
from moodtide.operators import clean


def test_rich_text(spark):
    values = ['["a",{"type":"link","text":"b"},"c"]', '"plain"', "[]", "null", None, "7"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    found = [r.t for r in rows.select(text.flatten_rich_text(F.parse_json("v")).alias("t")).collect()]
    assert found == ["a c", "plain", "", "", "", "7"]


def test_build_text(spark):
    rows = spark.createDataFrame([(None, "x"), ("a" * 499, "bcd"), ("é", None)], "title string, selftext string")
    assert [r.text for r in clean.build_text(rows).collect()] == [" x", "a" * 499 + " ", "é "]
    assert clean.build_text(rows, None).collect()[1].text == "a" * 499 + " bcd"


def test_cast_defaults(spark):
    rows = spark.createDataFrame(
        [("12.0", None, "0.5"), ("", "x", "nan"), ("99999999999", "3", None)], "score string, num_comments string, upvote_ratio string"
    )
    assert [tuple(r) for r in clean.cast_defaults(rows).collect()] == [(12, 0, 0.5), (1, 0, 1.0), (1, 3, 1.0)]


def test_epoch_is_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = spark.createDataFrame([("86399",), ("86400",), ("-1",), (None,)], "created_utc string")
        days = [r.date for r in clean.epoch_to_date(rows).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert days == [dt.date(1970, 1, 1), dt.date(1970, 1, 2), dt.date(1969, 12, 31), None]


def test_iso_to_date(spark):
    rows = spark.createDataFrame([("2021-02-03T23:59:59",), ("bad",), (None,)], "date string")
    assert [r.date for r in clean.iso_to_date(rows).collect()] == [dt.date(2021, 2, 3), None, None]


def test_drop_marked(spark):
    rows = spark.createDataFrame(
        [("ok", "fine"), ("[removed]", ""), ("a", "b [deleted] c"), ("[Removed]", None), (None, None)], "title string, selftext string"
    )
    assert [r.title for r in clean.drop_marked(rows).collect()] == ["ok", "[Removed]", None]
    assert clean.drop_marked(rows, enabled=False).count() == 5


def test_dedupe_keeps_the_best_copy_of_a_hot_post(spark):
    hot = [("s", "hot", i % 50, i % 7, f"t{i % 3}") for i in range(3000)]
    rest = [("s", str(i), 1, 1, "t") for i in range(100)]
    rows = spark.createDataFrame(hot + rest, "source string, id string, num_comments int, score int, title string").repartition(8)
    found = clean.dedupe_posts(rows)
    assert found.count() == 101
    best = found.where("id = 'hot'").head()
    assert (best.num_comments, best.score, best.title) == max(((c, s, t) for _, _, c, s, t in hot), key=lambda r: (r[0], r[1], -int(r[2][1])))


def test_dedupe_limits_copies_before_the_shuffle(spark):
    rows = spark.createDataFrame([("s", "1", 0, 1)], "source string, id string, num_comments int, score int")
    plan = clean.dedupe_posts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_windows(spark):
    rows = spark.createDataFrame([("s", dt.date(2020, 12, 31)), ("s", dt.date(2020, 1, 6)), ("s", dt.date(2021, 1, 1))], "source string, date date")
    found = {r.window_start: (r.window_end, r.n) for r in clean.fetch_windows(rows).collect()}
    assert found[dt.date(2020, 12, 31)] == (dt.date(2021, 1, 1), 1)
    assert found[dt.date(2020, 1, 6)] == (dt.date(2020, 1, 11), 1)
    assert found[dt.date(2021, 1, 1)] == (dt.date(2021, 1, 6), 1)
    assert len(found) == 74 - 1 + 1 and sum(n for _, n in found.values()) == 3


def test_cleaning_report(spark):
    rows = spark.createDataFrame(
        [("s", "a", "", 1, 0, 0.5, "2020-01-01"), ("s", "[removed]", "", 1, 0, 0.5, None), ("s", "b", "", 1, 0, 0.0, "2020-01-01"), ("s", "c", "", 1, 0, 1.0, None)],
        "source string, title string, selftext string, score int, num_comments int, upvote_ratio float, date string",
    )
    assert tuple(clean.cleaning_report(rows).head()) == ("s", 4, 1, 1, 2, 1)


def test_dedupe_keeps_rows_without_an_id(spark):
    rows = [("s", None, 1, 1), ("s", None, 1, 1), (None, "a", 1, 1), ("s", "a", 1, 1), ("s", "a", 2, 1)]
    df = spark.createDataFrame(rows, "source string, id string, num_comments int, score int")
    assert sorted((str(r.source), str(r.id), r.num_comments) for r in clean.dedupe_posts(df).collect()) == [
        ("None", "a", 1), ("s", "None", 1), ("s", "None", 1), ("s", "a", 2),
    ]
