import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodtide.llm import packing, queries
from moodtide.plans.registry import QUERIES

FILE = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
PUBLIC = Tokenizer.from_str(FILE.decode())


def fewest(items, capacity):
    """The least number of sequences, by trying every place for every piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, used):
        if len(used) >= best[0]:
            return
        if i == len(items):
            best[0] = len(used)
            return
        for k, fill in enumerate(used):
            if fill + items[i] <= capacity and fill not in used[:k]:
                place(i + 1, [*used[:k], fill + items[i], *used[k + 1 :]])
        place(i + 1, [*used, items[i]])

    place(0, [])
    return best[0]


INSTANCES = st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8)))


@settings(max_examples=400, deadline=None)
@given(INSTANCES)
def test_what_is_fixed_belongs_to_a_best_packing(instance):
    capacity, items = instance
    counts = np.bincount(items, minlength=capacity + 1)
    left = counts.copy()
    fixed = packing.reduce(left, capacity)
    assert all(sum(s * n for s, n in filled) <= capacity for filled, _ in fixed)
    rest = np.repeat(np.arange(capacity + 1), left).tolist()
    assert fewest(items, capacity) == sum(times for _, times in fixed) + fewest(rest, capacity)
    assert packing.lower_bound(counts, capacity) <= fewest(items, capacity) <= packing.plan(counts, capacity)["sequences"]


@settings(max_examples=200, deadline=None)
@given(INSTANCES)
def test_best_fit_takes_the_fullest_sequence_that_has_room(instance):
    capacity, items = instance
    one_by_one: list[int] = []
    for size in sorted(items, reverse=True):
        fitting = [k for k, fill in enumerate(one_by_one) if fill + size <= capacity]
        if fitting:
            one_by_one[max(fitting, key=lambda k: one_by_one[k])] += size
        else:
            one_by_one.append(size)
    groups = packing.best_fit(np.bincount(items, minlength=capacity + 1), capacity)
    fills = [sum(s * n for s, n in filled) for filled, many in groups for _ in range(many)]
    assert sorted(fills) == sorted(one_by_one)


def test_each_rule_of_dominance():
    def counts(*items):
        return np.bincount(items, minlength=101)

    assert packing.dominating(counts(90, 40, 30), 90, 100) == []  # nothing fits
    assert packing.dominating(counts(60, 40, 1, 1, 1, 1), 60, 100) == [40]  # fills the rest
    assert packing.dominating(counts(60, 35, 30, 20), 60, 100) == [35]  # one fits
    assert packing.dominating(counts(50, 45, 22, 21), 50, 100) == [45]  # the largest outweighs the best two
    assert packing.dominating(counts(50, 30, 18, 17), 50, 100) == [30, 18]  # the largest and the largest beside it
    assert packing.dominating(counts(50, 30, 25, 24, 10), 50, 100) is None
    assert packing.dominating(counts(50, 9, 8, 7, 6), 50, 100) is None  # three fit


def test_many_equal_pieces_cost_no_more_than_few():
    rng = np.random.default_rng(3)
    sizes = np.minimum(4096, rng.lognormal(5.5, 1.2, 100_000).astype(int) + 1)
    counts = np.bincount(sizes, minlength=4097) * 10_000_000
    found = packing.plan(counts)
    assert found["sequences"] <= 1.0001 * packing.lower_bound(counts, 4096) and len(found["rank"]) < 100_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" aBÉ\n\x1c\u0301'sΣİ1<|>", max_size=40)), max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    texts = [*texts, None, "A b<|endoftext|> c", "naïve  ÄRGER Naïve"]
    ids, at = packing.Encoder.of(FILE).encode(pa.array(texts, pa.string()))
    for text, lo, hi in zip(texts, at, at[1:]):
        assert ids[lo:hi].tolist() == PUBLIC.encode(text or "", add_special_tokens=False).ids


def test_remembered_words_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    encoder = packing.Encoder(FILE)
    for text in ["one two three four", "four three two one zero", "one one", "five"]:
        assert encoder.encode(pa.array([text]))[0].tolist() == PUBLIC.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) == 3


def test_other_rules_encode_whole_texts():
    other = packing.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
    ids, at = other.encode(pa.array(["one two  three"]))
    assert not other.by_words and ids.tolist() == other.tokenizer.encode("one two  three").ids


def checked(rows, texts, capacity):
    """Every piece is its document's, and every sequence has its pieces one behind the other."""
    expected = []
    for doc_id, text in texts:
        ids = np.array([*PUBLIC.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        assert ends[r.sequence_id] <= capacity
    return len(ends)


def test_awkward_rows(spark, awkward, nothing):
    given = awkward.withColumns({"length": F.lit("clash"), "offset": F.lit(7), "_text": F.lit(1)})
    rows = packing.pack(packing.pieces(given, FILE, ["doc_id"], 64), 64).collect()
    checked(rows, [(r.doc_id, r.text) for r in awkward.collect()], 64)
    assert packing.pack(packing.pieces(nothing, FILE, ["doc_id"])).count() == 0


def test_pieces_make_whole_sequences(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "<|endoftext|>", "δέλτα"], k=rng.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(texts + texts[:50], "doc_id long, text string").repartition(5)
    packed = packing.pack(packing.pieces(docs, FILE, ["doc_id"], 32, keep_ids=True), 32)
    packed = spark.createDataFrame(packed.collect(), packed.schema)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in packed.collect())


def test_pieces_that_are_too_long_are_an_error(spark):
    with pytest.raises(ValueError, match="9 tokens"):
        packing.pack(spark.createDataFrame([(9,)], "length long"), 8)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    rows = QUERIES["op13_packing"](spark, sf).collect()
    used = checked(rows, texts, 4096)
    assert used == packing.lower_bound(np.bincount([r.length for r in rows], minlength=4097), 4096)
