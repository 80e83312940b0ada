import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from moodtide.operators import clean
from moodtide.sources import readers, writers


def test_post_files(spark, tmp_path):
    head = "id,url,title,score,num_comments,created_utc,selftext,upvote_ratio\n"
    (tmp_path / "btc-submissions.csv").write_text(head + 'a,u,"He said ""hi"", ok",3,2,1577836800,"line one\nline two",0.87\n')
    (tmp_path / "Bitcoin-submissions.csv").write_text(head + "b,u,,4.0,,1577923200,,\n")
    (tmp_path / "btc-submissions-sia.csv").write_text(head + "c,u,x,1,1,1,x,1\n")
    posts = clean.epoch_to_date(clean.cast_defaults(clean.fill_text_nulls(readers.read_posts(spark, str(tmp_path), "reddit"))))
    found = {r.id: r for r in posts.collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"].title, found["a"].selftext) == ('He said "hi", ok', "line one\nline two")
    assert (found["a"].community, found["a"].source, found["b"].community) == ("btc", "reddit", "Bitcoin")
    assert (found["b"].score, found["b"].num_comments, found["b"].upvote_ratio) == (4, 0, 1.0)
    assert found["b"].date == dt.date(2020, 1, 2)


MESSAGES = [
    {"id": 1, "type": "message", "date": "2021-01-01T10:00:00", "text": 'plain "quoted" \n },\n {'},
    {"id": 2, "type": "message", "date": "2021-01-01T11:00:00", "text": ["a", {"type": "link", "text": "b"}, "c"], "reactions": [{"n": {"x": 1}}]},
    {"id": 3, "type": "service", "date": "2021-01-02T10:00:00"},
    *[{"id": i, "date": "2021-01-03T10:00:00", "text": f"number {i}"} for i in range(4, 400)],
]


def chat(spark, path, layout):
    read = clean.flatten_messages(readers.read_messages(spark, path, layout))
    return sorted((r.source, r.id, r.date, r.text) for r in read.collect())


def test_chat_layouts_agree(spark, tmp_path):
    for name, messages in (("room", MESSAGES), ("empty", []), ("single", MESSAGES[:1])):
        (tmp_path / name).mkdir()
        document = {"name": name, "type": "private", "id": 5, "messages": messages}
        (tmp_path / name / "result.json").write_text(json.dumps(document, indent=1, ensure_ascii=False))
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "result.json").write_text('{\n "name": "no messages"\n}')
    path = f"{tmp_path}/*/result.json"
    found = chat(spark, path, "document")
    assert len(found) == len(MESSAGES) + 1
    assert [t for s, i, _, t in found if s == "room" and i < 4] == ['plain "quoted" \n },\n {', "a c", ""]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert readers.read_messages(spark, path, "indented").rdd.getNumPartitions() > 4
        assert chat(spark, path, "indented") == found
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "room.json").write_text("\n".join(json.dumps(m) for m in MESSAGES))
    lines = [m[1:] for m in chat(spark, f"{tmp_path}/lines", "lines")]
    assert lines == [m[1:] for m in found if m[0] == "room"]


def test_market_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Time,x,BTC / NVT,RSI\n2020-01-01 00:00:00,1,2.5,\n2020-01-02,1,nan,50\n")
    found = [tuple(r) for r in readers.read_indicators(spark, str(tmp_path / "m.csv")).collect()]
    assert found == [(dt.date(2020, 1, 1), 2.5, None), (dt.date(2020, 1, 2), None, 50.0)]
    (tmp_path / "p.csv").write_text(",date,open,high,low,close,volume\n0,2020-01-01,1,3,0.5,2,10\n")
    assert tuple(readers.read_prices(spark, str(tmp_path / "p.csv")).head()) == ("price", dt.date(2020, 1, 1), 1.0, 3.0, 0.5, 2.0, 10.0)


def test_labelled_and_lexicon(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('sentence\tlabel\nit \'s "fine , really\t1\nbad\t0\n')
    assert [tuple(r) for r in readers.read_labelled(spark, str(tmp_path / "t.tsv")).collect()] == [('it \'s "fine , really', 1), ("bad", 0)]
    (tmp_path / "l.csv").write_text("term,polarity\ngood,0.5\nhard time,-0.35\nodd,x\n")
    assert {tuple(r) for r in readers.load_lexicon(spark, str(tmp_path / "l.csv")).collect()} == {("good", 0.5), ("hard time", -0.35), ("odd", None)}
    (tmp_path / "d.csv").write_text("term,polarity\ngood,0.5\ngood,0.4\n")
    with pytest.raises(ValueError, match="good"):
        readers.load_lexicon(spark, str(tmp_path / "d.csv"))


def test_normalise(spark):
    rows = spark.createDataFrame([("1", "x")], "a string, b string")
    found = readers.normalise_records(rows, {"b": "int", "c": "double", "a": "int"})
    assert found.columns == ["b", "c", "a"] and tuple(found.head()) == (None, None, 1)


def test_scored_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, " spaced \n text", 0.5), ("t", 2, 'q"uote', -0.5), ("t", 3, "", 0.0)], "source string, id int, title string, sia double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        writers.write_scored(rows, path, fmt)
        options = {"header": True, "multiLine": True, "escape": '"'} if fmt == "csv" else {}
        back = spark.read.format(fmt).schema("id int, title string, sia double, source string").options(**options).load(path)
        expected = {("s", 1, " spaced \n text", 0.5), ("t", 2, 'q"uote', -0.5), ("t", 3, "" if fmt == "parquet" else back.where("id = 3").head().title, 0.0)}
        assert {tuple(r) for r in back.select("source", "id", "title", "sia").collect()} == expected
        assert back.where("id = 3").head().title in ("", None)


def test_daily_round_trip(spark, tmp_path):
    rows = spark.range(20).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).alias("date"))
    writers.write_daily(rows, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 20


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a-submissions.csv").write_text(",title,url,created_utc,id,extra\n0,T,u,1577836800,x,e\n")
    row = readers.read_posts(spark, str(tmp_path)).head()
    assert (row.id, row.title, row.url, row.created_utc, row.selftext, row.community) == ("x", "T", "u", "1577836800", None, "a")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b-submissions.csv").write_text("url,id\nu,x\n")
    with pytest.raises(ValueError, match="title"):
        readers.read_posts(spark, str(tmp_path / "b"))
    (tmp_path / "l.tsv").write_text("label\tsentence\n1\tfine\n")
    assert tuple(readers.read_labelled(spark, str(tmp_path / "l.tsv")).head()) == ("fine", 1)
    (tmp_path / "lex.csv").write_text("polarity,note,term\n0.5,n,good\n")
    assert tuple(readers.load_lexicon(spark, str(tmp_path / "lex.csv")).head()) == ("good", 0.5)


def test_dates_in_milliseconds(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,open,high,low,close,volume\n1577836800000,1,2,0,1,5\n2020-01-02,1,2,0,1,5\n")
    assert [str(r.date) for r in readers.read_prices(spark, str(tmp_path / "p.csv")).orderBy("date").collect()] == ["2020-01-01", "2020-01-02"]


def test_writes_of_other_sources_stay_and_files_follow_the_size(spark, tmp_path):
    frame = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("source")).repartition(16)
    path = str(tmp_path / "scored")
    writers.write_scored(frame, path)
    writers.write_scored(frame.limit(5).withColumn("source", F.lit("third")), path)
    stored = readers.read_scored(spark, path)
    assert {r.source: r["count"] for r in stored.groupBy("source").count().collect()} == {"hot": 1800, "cold": 200, "third": 5}
    assert len(list((tmp_path / "scored").glob("*/part-*"))) <= 4
    writers.write_scored(frame.where("source = 'cold'").limit(3), path)
    assert readers.read_scored(spark, path).where("source = 'cold'").count() == 3
    for model, target in (("m", "a"), ("m", "b"), ("m", "a")):
        writers.write_predictions(frame.select("id"), str(tmp_path / "p"), model, target)
    assert readers.read_predictions(spark, str(tmp_path / "p")).groupBy("model", "target").count().count() == 2


def test_a_flow_goes_on_from_stored_scores(spark, tmp_path):
    from moodtide.operators import daily

    kinds = "source string, date date, sia_bert double, sia_vader double, sia double, title string, num_comments int"
    rows = [(f"s{i % 2}", dt.date(2020, 1, 1 + i % 3), 0.1 * i, 0.2, 0.3, "t" if i % 4 else "", i) for i in range(20)]
    scored = spark.createDataFrame(rows, kinds)
    writers.write_scored(scored, str(tmp_path / "s"))
    key = lambda df: sorted((r.source, r.date, round(r.sia_bert_sum, 9), r.num_posts, r.num_comments) for r in df.collect())
    assert key(daily.daily_sentiment(readers.read_scored(spark, str(tmp_path / "s")))) == key(daily.daily_sentiment(scored))


def test_broken_records_are_counted_and_layouts_found(spark, tmp_path):
    for name in ("lines", "document", "indented", "broken"):
        (tmp_path / name).mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(m) for m in MESSAGES[:4]) + '\n{"id": 9, "date": "20\n{"id": 10}\n')
    document = {"name": "x", "messages": MESSAGES[:4]}
    (tmp_path / "document" / "a.json").write_text(json.dumps(document))
    (tmp_path / "indented" / "a.json").write_text(json.dumps(document, indent=1))
    (tmp_path / "broken" / "a.json").write_text(json.dumps(document)[:-20])
    for name in ("lines", "document", "indented"):
        assert readers.detect_layout(spark, str(tmp_path / name)) == name
    report = lambda name, layout: tuple(readers.chat_report(spark, str(tmp_path / name), layout).head())
    assert report("lines", "lines") == ("lines", 5, 1, 1)
    assert report("document", "document") == ("document", 4, 0, 0)
    assert report("broken", "document")[3] == 1


@pytest.mark.parametrize("layout", ["lines", "document", "indented"])
def test_broken_records_fail_go_or_stay(spark, tmp_path, layout):
    """Of two files in the layout, one holds a record that is cut off."""
    good, bad = '{"id": 1, "date": "2020-01-01T00:00:00", "text": "a"}', '{"id": 2, "da'
    for n, record in enumerate((good, bad)):
        (tmp_path / f"c{n}").mkdir()
        body = {
            "lines": record + "\n",
            "document": '{"name": "c", "messages": [' + record + ("]}" if record == good else ""),
            "indented": '{\n "name": "c",\n "messages": [\n  {\n   ' + record[1:-1] + "\n  }\n ]\n}",
        }[layout]
        (tmp_path / f"c{n}" / "result.json").write_text(body)
    path = str(tmp_path / "*")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_messages(spark, path, layout, broken="fail").collect()
    assert [r.id for r in readers.read_messages(spark, path, layout, broken="drop").collect()] == [1]
    assert 1 in [r.id for r in readers.read_messages(spark, path, layout).collect()]
    with pytest.raises(ValueError, match="fail, drop or keep"):
        readers.read_messages(spark, path, layout, broken="ignore")
