"""The lexicon rules against the sentences and scores published with the rule model."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from moodtide.functions import text
from moodtide.operators import lexicon
from moodtide.session import small_side

TERMS = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "horrible": -2.5, "sux": -1.5, "no": -1.2}
TERMS |= {"uncompelling": -0.9, "non-performing": -1.0, "never": -0.4, "friend": 2.2, "problem": -1.7}
PUBLISHED = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431),
    ("The book was only kind of good.", 0.3832),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042),
    ("Today SUX!", -0.5461),
    ("", 0.0),
    ("nothing known", 0.0),
]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(list(TERMS.items()), "term string, polarity double")


def scored(spark, terms, texts, scorer, **options):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source string, id int, text string")
    return [r.sia_vader for r in scorer(rows, terms, **options).orderBy("id").collect()]


def test_published_sentences(spark, terms):
    found = scored(spark, terms, [t for t, _ in PUBLISHED], lexicon.lexicon_compound_emphasis)
    assert found == [pytest.approx(expected, abs=6e-5) for _, expected in PUBLISHED]


def squash(total):
    return total / (total * total + 15) ** 0.5


RULES = [
    ("never so good", -0.4 + 1.9 + 0.293),  # "never" is a term here, so only "so" acts
    ("without doubt good", 1.9),
    ("without any good", 1.9 * -0.74),
    ("no friend", 2.2 * -0.74),
    ("no problem at all", -1.7 * -0.74),
    ("least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("the bomb is good", 3.0),  # an idiom three and two words before the hit
    ("the bomb was never any good", 3.0 + 1.9),  # it stands for "never"
    ("barely good", 1.9 - 0.293),
    ("barely a good", 1.9 - 0.293 * 0.95),
    ("barely a real good", 1.9 - 0.293 * 0.9),
    ("barely horrible", -2.5 + 0.293),
    ("good good", 3.8),
]


def test_rules(spark, terms):
    found = scored(spark, terms, [sentence for sentence, _ in RULES], lexicon.lexicon_compound_emphasis)
    assert found == [pytest.approx(squash(total), abs=1e-9) for _, total in RULES]


def test_plain_total_ignores_rules(spark, terms):
    found = scored(spark, terms, ["NOT very good!!!", "(non-performing) loans", "good, good."], lexicon.lexicon_compound)
    assert found == [pytest.approx(squash(t)) for t in (1.9, -1.0, 3.8)]


def test_modifiers_without_emphasis(spark, terms):
    found = scored(spark, terms, ["NOT very good!!!", "very good but horrible"], lexicon.lexicon_compound_modifiers)
    assert found[0] == pytest.approx(squash((1.9 + 0.293) * -0.74))
    assert found[1] == pytest.approx(squash(1.9 + 0.293 - 2.5 - 0.293 * 0.9))


def test_carry_equals_join(spark, terms):
    rows = spark.createDataFrame([("a", 1, 5, "good"), ("a", 2, 6, ""), ("b", 1, 7, None)], "source string, id int, extra int, text string")
    for scorer in (lexicon.lexicon_compound, lexicon.lexicon_compound_modifiers, lexicon.lexicon_compound_emphasis):
        joined = scorer(rows, terms).select("source", "id", "extra", "sia_vader")
        carried = scorer(rows, terms, carry=["extra"])
        assert sorted(joined.collect()) == sorted(carried.select(*joined.columns).collect())
        assert joined.count() == 3


def test_large_lexicon_is_joined_without_broadcast(spark, terms, monkeypatch):
    sentences = [t for t, _ in PUBLISHED]
    expected = scored(spark, terms, sentences, lexicon.lexicon_compound_emphasis)
    monkeypatch.setattr(lexicon, "small_side", lambda df: df.hint("merge"))
    assert scored(spark, terms, sentences, lexicon.lexicon_compound_emphasis) == [pytest.approx(e) for e in expected]


@pytest.mark.parametrize("carry", [None, ["extra"]])
@pytest.mark.parametrize("scorer", [lexicon.lexicon_compound_modifiers, lexicon.lexicon_compound_emphasis])
def test_lexicon_above_the_bound_is_met_once(spark, terms, monkeypatch, scorer, carry):
    """One join with the words, and no shuffle that moves a post's columns with each word."""
    texts = [*[t for t, _ in PUBLISHED], *[t for t, _ in RULES], "NOT very good!!!", None]
    rows = spark.createDataFrame([("s", i // 2, i % 3, t) for i, t in enumerate(texts)], "source string, id int, extra int, text string")
    expected = sorted((r.id, r.extra, round(r.sia_vader, 9)) for r in scorer(rows, terms, carry=carry).collect())
    monkeypatch.setattr(lexicon, "small_side", partial(small_side, max_rows=3))
    found = scorer(rows, terms, carry=carry)
    assert sorted((r.id, r.extra, round(r.sia_vader, 9)) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= _word") == 1 and len(expected) == len(texts)


def test_lexicon_of_half_a_million_terms_moves_no_word(spark):
    many = spark.range(500_000).select(F.concat(F.lit("w"), F.col("id")).alias("term"), F.lit(0.5).alias("polarity"))
    rows = spark.createDataFrame([("s", 1, "w1 w499999 x")], "source string, id int, text string")
    found = lexicon.lexicon_compound_emphasis(rows, many, carry=[])
    assert "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()
    assert found.head().sia_vader == pytest.approx(squash(1.0))


def test_merge_prefers_domain(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, polarity double")
    domain = spark.createDataFrame([("b", -1.0), ("c", 0.5)], "term string, polarity double")
    assert {tuple(r) for r in lexicon.merge_lexicon(base, domain).collect()} == {("a", 1.0), ("b", -1.0), ("c", 0.5)}


def test_lookup(spark, terms):
    rows = spark.createDataFrame([("s", 1, "So GOOD, so (good) :) bad")], "source string, id int, text string")
    assert sorted((r.pos, r.term) for r in lexicon.lexicon_lookup(rows, terms).collect()) == [(1, "good"), (3, "good")]


def test_bare_text_agrees_with_plain_python(spark):
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def bare(token):
        inner = token.strip(marks)
        return token if len(inner) <= 2 else inner

    texts = ["Hello, (world)! isn't non-performing :) of, it's\n É x", "--- a--b-- ...été... 'tis'", " \t", "(ab) (abc) ((a.c))", "é,é é,é,é!"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.tokens(text.bare_text(F.col("t"))).alias("w"))
    assert [r.w for r in rows.collect()] == [[bare(t) for t in sentence.split()] for sentence in texts]


def test_capital_tokens(spark):
    texts = ["ABC def G1 123 É Éa A.B!", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.capital_tokens(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [4, 0]


@pytest.mark.parametrize("carry", [None, []])
@pytest.mark.parametrize("scorer", [lexicon.lexicon_compound, lexicon.lexicon_compound_modifiers, lexicon.lexicon_compound_emphasis])
def test_posts_without_an_id_or_with_a_doubled_one_keep_their_scores(spark, scorer, carry):
    terms = spark.createDataFrame([("good", 0.5), ("bad", -0.4)], "term string, polarity double")
    texts = [("s", None, "good"), ("s", None, "bad"), ("s", None, "x"), ("s", 1, "good"), ("s", 1, "good"), (None, 2, "bad")]
    df = spark.createDataFrame(texts, "source string, id int, text string")
    found = sorted(round(r.sia_vader, 4) for r in scorer(df, terms, carry=carry).collect())
    assert found == [-0.1027, -0.1027, 0.0, 0.128, 0.128, 0.128]
