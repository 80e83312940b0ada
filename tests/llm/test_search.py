import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import search

SCHEMA = "vec_id long, embedding array<float>, label string, list string, id int"


def plain(ids, x, query, k):
    far = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
    far[ids == query] = np.inf
    best = np.lexsort((ids, far))[:k]
    return [(int(ids[b]), far[b]) for b in best if np.isfinite(far[b])]


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01", "/root/testdata/sf0.1", "clusters"])
def test_recall_and_exact_scores(spark, table):
    if table == "clusters":
        rng = np.random.default_rng(1)
        centres = rng.normal(size=(40, 24)) * 3
        rows = [(i, (centres[i % 40] + rng.normal(size=24)).tolist(), "", "", 0) for i in range(6000)]
        df = spark.createDataFrame(rows, SCHEMA)
    else:
        df = spark.read.parquet(f"{table}/embeddings.parquet")
    data = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    got: dict = {}
    for r in search.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for query, found in got.items():
        best = plain(ids, x, query, 10)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        hits += len({v for _, v, _ in found} & {v for v, _ in best})
        for _, v, score in found:
            assert abs(score - np.sqrt(((x[ids == v][0] - x[ids == query][0]) ** 2).sum())) < 1e-12
    assert hits / (10 * len(got)) >= 0.9


@pytest.mark.parametrize("near, groups, size", [(1000, 3, 9), (300, 2, 5), (2000, 1, 5), (3, 1, 4)])
@pytest.mark.parametrize("seed", [1, 2])
def test_far_groups_get_all_their_neighbours(spark, near, groups, size, seed):
    """Groups smaller than k: the rest of the neighbours stand on lists far away."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(near, 8)), *[rng.normal(size=(size, 8)) * 0.1 + 100 * rng.normal(size=8) for _ in range(groups)]])
    asked = set(range(near, len(x)))
    df = spark.createDataFrame([(i, v.tolist(), "", "", int(i in asked)) for i, v in enumerate(x)], SCHEMA)
    got: dict = {}
    for r in search.search(df, F.exists("vector", lambda c: F.abs(c) > 12)).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == asked
    hits = [len(set(found) & {v for v, _ in plain(np.arange(len(x)), x, q, 10)}) for q, found in got.items()]
    assert all(len(found) == min(10, len(x) - 1) for found in got.values())
    assert sum(hits) >= 0.9 * sum(len(found) for found in got.values())


def test_every_centroid_is_reached():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        groups = [rng.normal(size=(400, 8)) + 50 * rng.normal(size=8) for _ in range(seed + 1)]
        lists = search.Lists.of(np.concatenate(groups))
        for x in rng.normal(size=(3, 8)):
            assert len(lists.walk(x, len(lists.centres))[0]) == len(lists.centres)


def test_blocks_of_a_list_are_searched_together(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 50), 0.0], "", "", 0) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r.query_id, r.rank, r.vec_id, r.score)
    whole = sorted(map(key, search.search(df, F.col("id") % 100 == 0).collect()))
    monkeypatch.setattr(search, "BLOCK", 30)
    assert sorted(map(key, search.search(df, F.col("id") % 100 == 0).collect())) == whole


def test_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(4)
    sample = rng.normal(size=(8000, 16))
    lists = search.Lists.of(sample)
    sizes = np.bincount(np.concatenate([search._near(sample, lists.centres).argmin(1)]))
    assert sizes.max() <= 6 * search.CLUSTER
    hits = 0
    for x in rng.normal(size=(50, 16)):
        nodes, _ = lists.walk(x, search.BREADTH)
        hits += len(set(nodes[:10]) & set(np.argsort(search._near(x[None], lists.centres)[0])[:10]))
    assert hits >= 475


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a", "l", 9), (1, [1.0, 0.0], None, None, None), (2, [2.0, 0.0], "a", "l", 9), (3, None, "a", "l", 9), (4, [], "a", "l", 9),
        (5, [0.0, 0.0], "a", "l", 9), (6, [nan, 1.0], "a", "l", 9), (7, [None, 1.0], "a", "l", 9), (8, [inf, 1.0], "a", "l", 9), (9, [1.0, 2.0, 3.0], "a", "l", 9),
        (100, [2.0, 0.0], "a", "l", 9), (100, [2.0, 0.0], "a", "l", 9), (200, [0.0, 0.0], "a", "l", 9), (None, [1.0, 1.0], "a", "l", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in search.search(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(f) for q, f in got.items()} == {0: [(1, 1, 0.0), (2, 2, 1.0), (3, 100, 1.0)], 100: [(1, 2, 0.0), (2, 0, 1.0), (3, 1, 1.0)]}
    assert search.search(df.limit(0), F.lit(True)).count() == 0
    assert search.search(df.where("vec_id = 1"), F.lit(True)).count() == 0
