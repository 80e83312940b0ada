import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from moodtide.llm import bpe, mixing, queries
from moodtide.plans.registry import QUERIES

from .conftest import AWKWARD, prose
from .test_jaccard import plain
from .test_pii import plain as plain_spans

DIR = "/root/testdata/sf0.001"


def test_stages_of_the_pipeline_against_brute_force(spark):
    docs = queries.table(spark, DIR, "documents")
    columns = docs.columns
    kept = pipeline.language(spark, docs, DIR)
    assert kept.columns == columns and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()

    single = pipeline.near_copies(spark, kept, DIR)
    groups = plain([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, c) in groups.items() if d == c)

    private = pipeline.personal_data(spark, single, DIR)
    assert private.columns == columns
    before = {r.doc_id: r.text for r in single.collect()}
    for r in private.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(before[r.doc_id]):
            assert r.text == before[r.doc_id] or "[" in r.text

    mixed = pipeline.mixture(spark, private, DIR)
    assert mixed.columns == columns
    assert mixed.agg(F.sum(mixing.words_in(F.col("text")))).head()[0] == mixing.mix(private, ["doc_id"]).agg(F.sum("taken")).head()[0]

    codec = bpe.Codec.of(open(public_tokenizers.path(queries.TOKENIZER), "rb").read(), public_tokenizers.PATTERN)
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ids, special_tokens={})
    texts = sorted((r.doc_id, public.encode_ordinary(r.text)) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids) for r in pipeline.tokens(spark, mixed, DIR).collect()) == texts


def test_whole_pipeline_repeats_itself(spark):
    rows = [sorted((r.doc_id, r.ids_sha256) for r in QUERIES["pipeline"](spark, DIR).collect()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_awkward_rows_pass_every_stage(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIR)
            assert docs.columns == awkward.columns, name
        docs = pipeline.tokens(spark, docs, DIR)
        assert docs.where("decoded_sha256 is null").count() == 0
    kept = pipeline.near_copies(spark, pipeline.language(spark, awkward, DIR), DIR)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "6", "8", "None"]  # none of the trigrams of 5 is known
    assert len(AWKWARD) == 10


def test_copies_of_a_repeated_id_leave_its_other_text(spark):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (2, prose(5, 80)), (2, prose(5, 80)), (None, prose(6, 40)), (None, prose(6, 40)), (3, None)]
    kept = pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    wanted = [(1, prose(1, 80)), (2, prose(5, 80)), (3, None), (None, prose(6, 40)), (None, prose(6, 40))]
    assert sorted(map(str, kept)) == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in wanted)
