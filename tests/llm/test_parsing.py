import random

import numpy as np
from pyspark.sql import functions as F

from moodtide.llm import parsing, queries
from moodtide.plans.registry import QUERIES


def text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh  é😀") for _ in range(n))


def like(a, b):
    used = ((a > 0) | (b > 0)).sum()
    return ((a == b) & (a > 0)).sum() / used if used else 1.0


def test_equal_texts_have_equal_fingerprints_in_any_company():
    alone = parsing.fingerprints([text(1, 500)])[0]
    among = parsing.fingerprints([text(2, 90), "", text(1, 500), None, "a", text(1, 500), "a" * 9000])
    assert (among[2] == alone).all() and (among[5] == alone).all()
    assert not among[1].any() and not among[3].any() and among[4].any() and among[6].any()


def test_interior_phrases_do_not_depend_on_the_offset():
    shared = text(3, 2000)
    for shift in (1, 2, 3, 7, 50):
        a, b = parsing.fingerprints([text(4, 100) + shared, text(5, 100 + shift) + shared])
        assert like(a, b) > 0.75
    a, b = parsing.fingerprints([text(6, 2000), text(7, 2000)])
    assert like(a, b) < 0.1


def test_next_document_and_edits_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 10**9), text(i, rng.randint(0, 40))) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = sorted((r.k, r.t, r.next_t) for r in parsing.with_next(df, "k", ["t"]).collect())
    order = sorted(rows)
    assert got == sorted((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    pair = df.limit(1).select(F.lit("abcdeé😀").alias("a"), F.lit("xy").alias("b"))
    assert pair.select(parsing.edited(F.col("a"), F.col("b")).alias("e")).head().e == "abcd" + "xy"


def test_likeness_and_awkward_rows(spark, awkward, nothing):
    texts = awkward.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = parsing.with_next(texts, "doc_id", ["text"], {"p": parsing.fingerprint(F.col("text"))})
    rows = rows.withColumn("near", parsing.likeness(F.col("p"), F.col("next_p"))).collect()
    assert len(rows) == awkward.count()
    near = {(r.doc_id, r.near) for r in rows}
    assert (1, 1.0) in near and (3, 1.0) in near and (5, 0.0) in near
    assert parsing.with_next(nothing.select("doc_id", "text"), "doc_id", ["text"]).count() == 0
    one = spark.createDataFrame([(5, "only")], "doc_id long, text string")
    assert parsing.with_next(one, "doc_id", ["text"]).head().next_text == "only"


def test_query_likeness_follows_the_edit(spark):
    rows = QUERIES["op6_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == queries.table(spark, "/root/testdata/sf0.001", "documents").count()
    long = [r for r in rows if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert 0.2 < np.mean([r.near_edited for r in long]) < 0.5
