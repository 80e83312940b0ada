import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import langid, queries, scoring
from moodtide.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def plain(rows):
    """Counts and base scores by their definitions."""
    held = {d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in rows}
    counts = Counter(t for d, text in rows if not held[d] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in rows:
        mine = tokens(text)
        out.append((d, held[d], len(mine), sum(counts[t] > 0 for t in mine), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine)))
    return out, v


def key(row):
    return (row[0] is not None, row[0], row[2], round(row[5], 6))


def check(rows, df):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scoring.score(df, langid.fold(F.col("doc_id"), 5) != 1).collect()]
    expected, _ = plain(rows)
    assert len(got) == len(rows)
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert g[:5] == e[:5] and abs(g[5] - e[5]) < 1e-6 * max(1, abs(e[5])) and -math.inf < g[6] < 0
    return got


@pytest.mark.parametrize("batch", [2_000, 4_000_000])
def test_counts_and_base_scores_equal_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(scoring, "BATCH_BYTES", batch)
    monkeypatch.setattr(scoring, "RANGE_BYTES", 50_000)
    docs = queries.table(spark, DIR, "documents").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], docs)


def test_model_is_a_probability_and_beats_the_base_on_held_out_text(spark):
    rows = QUERIES["op8_scoring"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_are_those_of_the_mixture_that_made_the_counts():
    rng = np.random.default_rng(1)
    shares = rng.dirichlet([1, 1, 1], 400)
    truth = np.array([0.6, 0.3, 0.1])
    # a cell's expected count under the true mixture makes the true weights the fixed point
    table = np.column_stack([np.full(400, 3), shares, (shares @ truth) * 1000])
    weights = scoring.learn_weights(table)
    likelihood = lambda w: (table[:, 4] * np.log(shares @ w)).sum()
    assert np.isclose(weights.sum(axis=1), 1).all() and (weights[1:] > 0).all() and weights[0, 0] == 0
    assert likelihood(weights[3]) >= likelihood(np.array(scoring.DEFAULT)) and (weights[4] == weights[3]).all()


def test_pairs_sum_to_one_over_the_vocabulary(spark):
    """The mixture of any context is a distribution over the known words, the end and the unknown word."""
    train = [(i, t) for i, t in enumerate(["a b a", "b b a", "a c", "c a b"] * 15)]
    docs = spark.createDataFrame([*train, *[(1000 + i, f"zz {w}") for i, w in enumerate(["a", "b", "c", "new", ""])]], "doc_id long, text string")
    got = {r.doc_id: r.score for r in scoring.score(docs, F.col("doc_id") < 1000).collect()}
    first = got[1004]  # zz, end
    after = [10 ** (got[1000 + i] - first) for i in range(4)]
    assert all(x > 0 for x in after) and after[0] > after[3]


def test_awkward_rows(awkward, nothing):
    check([(r.doc_id, r.text) for r in awkward.collect()], awkward.select("doc_id", "text"))
    assert scoring.score(nothing, F.lit(True)).count() == 0
    assert {r.n_known for r in scoring.score(awkward, F.lit(False)).collect()} == {0}
