"""Emoji and word pieces against plain loops."""

import random
import re

import pytest

from moodtide.operators import encode, lexicon
from moodtide.plans import fixtures as fx
from moodtide.sources import readers


def told(text, names):
    """Emoji by emoji: the longest key at the first place that has one."""
    out, at, beside, changed = "", 0, True, False
    while at < len(text):
        key = max((k for k in names if text.startswith(k, at)), key=len, default=None)
        if key is None:
            out, beside, at = out + text[at], text[at] == " ", at + 1
        else:
            out, beside, at, changed = out + ("" if beside else " ") + names[key], False, at + len(key), True
    return out.strip(" ") if changed else out


def test_emoji_are_described_longest_first(spark):
    draw, names = random.Random(1), fx.EMOJI
    parts = [*names, "\U0001f3fd", "‍", " ", "a", "good ", "️", "*", "\U0001f1e9"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 9))) for _ in range(300)] + [None, "", "  plain  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.text for r in lexicon.translate_emoji(rows, fx.emoji(spark)).collect()}
    assert found == {i: None if t is None else told(t, names) for i, t in enumerate(texts)}
    assert lexicon.translate_emoji(rows, fx.emoji(spark).where("false"), out="o").where("o <=> text").count() == len(texts)


def test_emoji_count_in_the_score_and_stay_in_the_text(spark):
    terms = spark.createDataFrame([("grin", 2.0)], "term string, polarity double")
    rows = spark.createDataFrame([("s", 1, "xy\U0001f600"), ("s", 2, "xy"), ("s", 3, None)], "source string, id int, text string")
    plain = lexicon.lexicon_compound_emphasis(rows, terms)
    assert [r.sia_vader for r in plain.orderBy("id").collect()] == [0.0, 0.0, 0.0]
    spoken = lexicon.lexicon_compound_emphasis(rows, terms, emoji=fx.emoji(spark))
    assert spoken.columns == plain.columns
    found = spoken.orderBy("id").collect()
    assert found[0].text == "xy\U0001f600" and found[0].sia_vader == pytest.approx(2 / 19**0.5) and found[1].sia_vader == found[2].sia_vader == 0
    narrow = lexicon.lexicon_compound_emphasis(rows, terms, carry=[], emoji=fx.emoji(spark)).orderBy("id").collect()
    assert [r.sia_vader for r in narrow] == [r.sia_vader for r in found]


def test_large_tables_are_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexicon, "EMOJI_ROWS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        lexicon.translate_emoji(spark.createDataFrame([("x",)], "text string"), fx.emoji(spark))
    (tmp_path / "e.tsv").write_text('emoji\tdescription\n☠\tskull "and" bones\n')
    assert tuple(readers.load_emoji(spark, str(tmp_path)).head()) == ("☠", 'skull "and" bones')
    with pytest.raises(ValueError, match="more than 1 pieces"):
        encode.split_words(spark.createDataFrame([("x",)], "term string"), spark.createDataFrame([("x", 4), ("y", 5)], "term string, token_id int"), most=1)


def test_unseen_words_are_cut_into_the_longest_pieces(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdé", k=draw.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(60)] + [None, ""]
    seen = spark.createDataFrame([(t,) for t in texts], "text string")
    table = encode.with_characters(encode.build_vocab(seen, size=25)).union(spark.createDataFrame([("##ab", 900), ("##abc", 901)], "term string, token_id int"))
    pieces = {r.term: r.token_id for r in table.collect()}
    assert len(set(pieces.values())) == len(pieces) and {"##a", "a", "##é"} <= set(pieces)
    held = ["".join(draw.choices("abcdé", k=draw.randint(1, 30))) for _ in range(40)] + ["abc xyz", "a-b " * 40]
    rows = spark.createDataFrame(list(enumerate([*texts, *held])), "id int, text string").repartition(3)

    def cut(word):
        ids, at = [], 0
        while at < len(word):
            ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in pieces]
            if not ends:
                return [encode.UNKNOWN]
            ids.append(pieces[("##" if at else "") + word[at : ends[0]]])
            at = ends[0]
        return ids

    for maxlen in (8, 40):
        for r in encode.encode_pieces(rows, table, maxlen, carry=["text"]).collect():
            tokens = re.findall(r"[^\W_]+|[^\w\s]", (r.text or "").lower())
            body = [i for t in tokens for i in cut(t)][: maxlen - 2]
            assert r.input_ids == [encode.START, *body, encode.END, *[encode.PAD] * (maxlen - 2 - len(body))]
            assert r.attention_mask == [int(i != 0) for i in r.input_ids]
    known = encode.encode_pieces(rows.where("id between 62 and 101"), table, 40).collect()
    assert len(known) == 40 and not any(encode.UNKNOWN in r.input_ids for r in known)  # held-out words of known characters


def test_a_vocabulary_beyond_the_broadcast_bound_encodes_alike(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(i, " ".join(rng.choices(["the", *words], [60, *[1] * 20], k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "unseen the unseen")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(4)
    vocab = encode.build_vocab(texts.where("id < 60"))
    whole = {r.id: r for r in encode.encode_sequence(texts, vocab, 10).collect()}
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 3)
    cut = encode.encode_sequence(texts, vocab, 10)
    assert {r.id: r for r in cut.collect()} == whole and len(whole) == 63
    assert "Union" in cut._jdf.queryExecution().optimizedPlan().toString()
