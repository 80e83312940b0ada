import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moodtide.llm import bpe, queries
from moodtide.plans.registry import QUERIES

RANKS = open(public_tokenizers.path(queries.TOKENIZER), "rb").read()
CODEC = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
PUBLIC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ids, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_every_key():
    assert sorted(CODEC.hash.find(CODEC.keys)) == list(range(len(CODEC.keys)))
    assert (CODEC.keys[CODEC.hash.find(CODEC.keys)] == CODEC.keys).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_encoding_equals_the_public_library_and_round_trips(texts):
    flat, places = CODEC.encode(texts)
    for text, lo, hi in zip(texts, places, places[1:]):
        assert flat[lo:hi].tolist() == PUBLIC.encode_ordinary(text)
    data, ends = CODEC.decode(flat, places)
    assert [data.tobytes()[a:b].decode() for a, b in zip(ends, ends[1:])] == texts


def test_plain_pattern_splits_like_the_given_one():
    plain = bpe.plain_pattern(public_tokenizers.PATTERN)
    whole = "".join(f"a{c}1{c} {c}{c} b" for c in bpe._PLANE if c != "\x00")
    assert plain.findall(whole) == CODEC.pattern.findall(whole)
    assert bpe.plain_pattern(r"\w+|.") is None


def test_memory_bound_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    words = ["qxzqv", "wvvkq", "zzqqx", "qxzqv", "kkqzx", "wvvkq"] * 3
    flat, _ = CODEC.encode([" ".join(words), "<|endoftext|>" + "q" * 500])
    assert flat.tolist() == PUBLIC.encode_ordinary(" ".join(words)) + PUBLIC.encode_ordinary("<|endoftext|>" + "q" * 500)


def test_unknown_ids_are_an_error_and_null_ids_stay_null(spark):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        CODEC.decode(np.array([10**6]), np.array([0, 1]))
    df = spark.createDataFrame([(None,), ([],), ([15496],)], "ids array<int>")
    out = df.select(bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN).alias("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in out] == [None, b"", b"Hello"]


def test_awkward_rows(spark, awkward, nothing):
    rows = queries.encoded(spark, awkward, ["doc_id"]).collect()
    assert len(rows) == awkward.count()
    for row, source in zip(rows, awkward.collect()):
        ids = PUBLIC.encode_ordinary(source.text or "")
        assert (row.doc_id, row.ids, row.n_tokens) == (source.doc_id, ids, len(ids))
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((source.text or "").encode()).hexdigest()
    assert queries.encoded(spark, nothing, ["doc_id"]).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = QUERIES["op2_bpe_codec"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, PUBLIC.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest()


def test_a_batch_is_encoded_and_decoded_in_small_pieces():
    texts = pa.array(["some words, others " * 100] * 1000)
    pieces = bpe._pieces(texts, np.full(1000, 1900))
    assert pa.concat_arrays(pieces).equals(texts) and max(sum(map(len, p.to_pylist())) for p in pieces) < 300_000
    ids = pa.array([[15496] * 1000] * 1000, pa.list_(pa.int32()))
    assert max(len(p.flatten()) for p in bpe._pieces(ids, np.full(1000, 1000))) < 300_000
