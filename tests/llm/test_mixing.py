from collections import defaultdict

from pyspark.sql import functions as F

from moodtide.llm import mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def docs(spark, counts):
    rows = [(n, " ".join(["w"] * (1 + n % 37)), s) for n, s in enumerate(s for s, c in counts.items() for _ in range(c))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_taken_words(spark):
    df = docs(spark, {"a": 400, "b": 3, "c": 900, "d": 50, None: 20, "É": 60})
    rows = mixing.mix(df, ["doc_id", "source"], shard_documents=100).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    expected = plain_targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - expected[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 16 * 10
    again = mixing.mix(df.repartition(3), ["doc_id", "source"], shard_documents=100).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_apportionment_equals_the_highest_quotients(spark):
    weights = [5300.0, 2400.0, 2300.0, 1.0, 0.0, 700.0, 700.0]
    for seats in (0, 1, 3, 10, 57, 1000):
        quotients = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(weights) if w for k in range(seats + 1)))[:seats]
        expected = [sum(1 for _, i in quotients if i == j) for j in range(len(weights))]
        df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "i int, w double").withColumn("h", F.lit(seats))
        got = mixing.apportion(df, [], F.col("h"), F.col("w"), [F.col("i")], "won").orderBy("i").collect()
        assert [r.won for r in got] == expected


def test_mixed_documents_hold_the_taken_words_and_keep_the_columns(spark, awkward):
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    words = lambda t: len((t or "").encode().split())
    got = sum(words(r.text) for r in out.collect())
    assert got == sum(r.taken for r in mixing.mix(awkward, ["doc_id"]).collect())


def test_parts_keep_the_white_space_between_words(spark):
    text = "one\ttwo\n three  four five six seven eight"
    df = spark.createDataFrame([(1, text, "a"), (2, "x " * 20, "b")], "doc_id long, text string, source string")
    for r in mixing.mixed_documents(df, block_words=1).where("doc_id = 1").collect():
        assert r.text in text


def test_empty_tables(spark, nothing):
    assert mixing.mix(nothing, ["doc_id"]).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank, ["doc_id"]).collect()] == [0, 0]
