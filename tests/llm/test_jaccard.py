import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import jaccard
from moodtide.llm.components import components


def plain_sets(rows, size):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return sets


def plain(rows, size, percent):
    sets = plain_sets(rows, size)
    least = {doc: doc for doc in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {doc: (len(sets[doc]), root(doc)) for doc in docs}


def corpus(seed, bases=12, copies=9):
    """Near copies of several degrees, exact copies, shared passages, chains of copies of copies."""
    rng, texts = random.Random(seed), []
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice("aeiou") + str(rng.randint(0, 30))
    passage = [word() for _ in range(40)]
    for _ in range(bases):
        text = [word() for _ in range(rng.randint(1, 150))]
        if rng.random() < 0.5:
            text += passage
        texts.append(text)
        for _ in range(copies):
            source = rng.choice(texts[-3:]) if rng.random() < 0.5 else text
            copy = list(source)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, "  ".join(t).upper() if i % 7 == 0 else "\n".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df).collect()}
    assert got == plain(rows, 4, 85)


def test_other_size_and_threshold(spark):
    rows = corpus(5, bases=6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == plain(rows, 5, 80)


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        common = np.zeros(jaccard.COUNTERS, np.int32)
        common[rng.integers(0, jaccard.COUNTERS, 5)] = 1000
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        common[(a[: len(a) // 2] >> jaccard._SHIFT).astype(int)] = 50
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            p, q = jaccard.prefix(a, common, 85), jaccard.prefix(b, common, 85)
            shared = len(np.intersect1d(p, q))
            need = -(-85 * (len(a) + len(b)) // 185)
            assert shared >= 1 and shared + max(len(a) - len(p), len(b) - len(q)) >= need


def test_components_of_chains_hubs_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_awkward_rows(spark, awkward, nothing):
    rows = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(awkward).collect())
    by_id = {r[1]: r[2:] for r in rows}
    assert len(rows) == awkward.count()
    assert by_id[1] == (77, 1) and by_id[2] == (77, 1) and by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (1, 5)
    assert by_id[None] == (57, None) and by_id[6][1] == 6
    assert jaccard.link(nothing).count() == 0
    assert jaccard.link(awkward.where(F.col("text") == "")).count() == 1
