"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample of vectors (``SAMPLE``) by splitting clusters until none holds
more than its share, so lists start balanced. Every vector is put on the list of its nearest centroid and,
where it lies near a boundary, on the lists of up to ``COPIES`` centroids that are nearly as near (distance
at most ``REACH`` times the least). A query finds its nearest centroids by a best-first walk over a graph of
neighbouring centroids held in memory, and reads lists, nearest first, until they hold as many vectors as it asks for, and
then all whose centroids are at most ``PRUNE`` times as far as the last of these. Centroids and graph have a fixed greatest size; lists that grow beyond ``BLOCK`` vectors are
read in blocks by several tasks, so more data means longer lists in more blocks.

Within the lists read, distances are exact, in double precision on the original vectors; ties go to the
smaller id. A query finds itself never.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
vectors of another length than the most frequent one (the smaller among equals). Repeated rows of one id
and vector count once. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.llm.sampling import by_hash
from moodtide.session import materialise, scratch_path

#: Rows the centroids are fitted on, vectors of the sample in a cluster, neighbours of a centroid in the graph.
SAMPLE, CLUSTER, NEIGHBOURS = 50_000, 100, 16
#: Greatest number of lists of a vector and their greatest relative distance; greatest relative distance of the lists
#: that a query reads; centroids that a walk keeps, for a vector and for a query.
COPIES, REACH, PRUNE, BREADTH, PROBES = 4, 1.15, 1.5, 64, 128
#: Vectors of a list, and queries that read it, that one task compares.
BLOCK = 20_000


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector (array<double>) of the rows that take part."""
    doubles = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), doubles.alias("vector")).where("id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    return rows.where(F.size("vector") == (common[0]["n"] if common else 0))


def _matrix(values: pa.Array) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances between rows and centres; good enough to choose lists."""
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return np.sqrt(np.maximum(square, 0))


def balanced_centres(x: np.ndarray, most: int) -> np.ndarray:
    """Split the rows by 2-means, halving at the median of the two distances, until no part has more than ``most``."""
    rng, parts, centres = np.random.default_rng(7), [np.arange(len(x))], []
    while parts:
        part = parts.pop()
        if len(part) <= most:
            centres.append(x[part].mean(0))
            continue
        own = x[part]
        pair = own[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            lean = _near(own, pair)
            order = np.argsort(lean[:, 0] - lean[:, 1], kind="stable")
            half = len(part) // 2
            pair = np.stack([own[order[:half]].mean(0), own[order[half:]].mean(0)])
        parts += [part[order[:half]], part[order[half:]]]
    return np.array(centres)


@dataclass
class Lists:
    """Centroids and the graph that a search walks."""

    centres: np.ndarray
    graph: list[np.ndarray]
    #: Vectors that have each list as their nearest one, told apart by their ids; known once the vectors are listed.
    held: np.ndarray | None = None

    @classmethod
    def of(cls, sample: np.ndarray) -> Lists:
        centres = balanced_centres(sample, CLUSTER)
        # a few rounds of 2-means leave centres off; one pass of means puts them into their cells
        own = np.concatenate([_near(sample[i : i + 4096], centres).argmin(1) for i in range(0, len(sample), 4096)])
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        order = np.argsort(_near(centres, centres), axis=1, kind="stable")
        return cls(centres, connected(centres, order[:, 1 : NEIGHBOURS + 1]))

    @staticmethod
    def starts(count: int) -> np.ndarray:
        """The spread centroids that every walk begins with."""
        return np.unique(np.linspace(0, count - 1, 8).astype(int))

    def walk(self, x: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """About the nearest ``breadth`` centroids of one vector, nearest first, by best-first search from spread starts."""
        seen = np.zeros(len(self.centres), bool)
        found: list[tuple[float, int]] = []  # the best so far, worst on top
        todo: list[tuple[float, int]] = []

        def add(nodes: np.ndarray) -> None:
            nodes = nodes[~seen[nodes]]
            seen[nodes] = True
            for far, node in zip(np.sqrt(((self.centres[nodes] - x) ** 2).sum(1)).tolist(), nodes.tolist()):
                if len(found) < breadth or far < -found[0][0]:
                    heapq.heappush(todo, (far, node))
                    heapq.heappush(found, (-far, node))
                    if len(found) > breadth:
                        heapq.heappop(found)

        add(self.starts(len(self.centres)))
        while todo:
            far, node = heapq.heappop(todo)
            if len(found) >= breadth and far > -found[0][0]:
                break
            add(self.graph[node])
        best = sorted((-far, node) for far, node in found)
        return np.array([n for _, n in best]), np.array([far for far, _ in best])

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector."""
        out = []
        for row in x:
            nodes, far = self.walk(row, BREADTH)
            out.append(nodes[far <= REACH * far[0]][:COPIES])
        return out

    def probe(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """The lists that each query reads; they hold ``k`` vectors besides the query, if there are so many."""
        out = []
        for row in x:
            nodes, far = self.walk(row, PROBES)
            enough = np.flatnonzero(np.cumsum(self.held[nodes]) > k)
            if not len(enough):  # all lists then, in their exact order
                far = np.sqrt(((self.centres - row) ** 2).sum(1))
                nodes = np.argsort(far, kind="stable")
                far = far[nodes]
                enough = np.flatnonzero(np.cumsum(self.held[nodes]) > k)
            last = far[enough[0]] if len(enough) else far[-1]
            out.append(nodes[far <= PRUNE * last] if last > 0 else nodes)
        return out


def connected(centres: np.ndarray, nearest: np.ndarray) -> list[np.ndarray]:
    """Neighbours in both directions, and edges more to every centroid that no walk from the starts would come to."""
    edges: list[set[int]] = [set(row) for row in nearest.tolist()]
    for node, row in enumerate(nearest.tolist()):
        for other in row:
            edges[other].add(node)
    reached = np.zeros(len(centres), bool)

    def spread(todo: list[int]) -> None:
        reached[todo] = True
        while todo:
            new = [n for n in edges[todo.pop()] if not reached[n]]
            reached[new] = True
            todo += new

    spread(Lists.starts(len(centres)).tolist())
    while not reached.all():
        left, here = np.flatnonzero(~reached), np.flatnonzero(reached)
        far = _near(centres[left], centres[here])
        a, b = np.unravel_index(far.argmin(), far.shape)
        edges[left[a]].add(int(here[b]))
        edges[here[b]].add(int(left[a]))
        spread([int(left[a])])
    return [np.array(sorted(e), np.int64) for e in edges]


def fit(rows: DataFrame) -> Lists | None:
    """Centroids and graph from a sample by hash of at most ``SAMPLE`` vectors."""
    sample = by_hash(rows, SAMPLE, "id", "vector").select("vector").toArrow()
    return Lists.of(_matrix(sample.column("vector"))) if sample.num_rows else None


def _listed(rows: DataFrame, lists: Lists, k: int | None = None) -> DataFrame:
    """A row (list, id, vector, own) for each list of a vector, or of a query for ``k``; ``own`` marks the nearest one."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector"))
                found = lists.assign(x) if k is None else lists.probe(x, k)
                many = np.array([len(f) for f in found])
                at = np.repeat(np.arange(len(x)), many)
                own = np.zeros(len(at), bool)
                own[np.cumsum(many) - many] = True
                columns = [pa.array(np.concatenate(found), pa.int32()), *[batch.column(c).take(pa.array(at)) for c in ("id", "vector")], pa.array(own)]
                yield pa.RecordBatch.from_arrays(columns, ["list", "id", "vector", "own"])

    return rows.mapInArrow(deal, "list int, id long, vector array<double>, own boolean")


def _compare(k: int):
    """For one block of a list: the k nearest of the block for each query of the list."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, x = left.column("id").to_numpy(), _matrix(left.column("vector"))
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        queries = _matrix(right.column("vector")) if len(right) else np.zeros((0, x.shape[1] if len(x) else 0))
        for q, row in zip(right.column("id").to_pylist(), queries):
            far = np.sqrt(((x - row) ** 2).sum(1))
            far[ids == q] = np.inf
            best = np.argpartition(far, k)[:k] if len(far) > k else np.arange(len(far))
            if len(far) > k:  # all that tie with the last one, then the smaller ids
                best = np.flatnonzero(far <= far[best].max())
            best = best[np.lexsort((ids[best], far[best]))][:k]
            best = best[np.isfinite(far[best])]
            out.append((np.full(len(best), q), ids[best], far[best]))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return nearest


def search(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``queries`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    lists = fit(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if lists is None:
        return spark.createDataFrame([], schema)
    path = scratch_path(spark, "lists")
    _listed(rows, lists).write.parquet(path)
    posted = spark.read.parquet(path)
    lists.held = np.zeros(len(lists.centres), np.int64)
    for row in posted.where("own").groupBy("list").agg(F.count_distinct("id").alias("n")).collect():  # a row a centroid
        lists.held[row["list"]] = row["n"]
    path = scratch_path(spark, "asked")
    _listed(rows.where(queries), lists, k).drop("own").write.parquet(path)
    asked, posted = spark.read.parquet(path), posted.drop("own")
    # a list is compared block by block: blocks of its vectors with blocks of the queries that read it
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    readers = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    grid = F.broadcast(materialise(sizes.join(readers, "list")))  # a row per centroid, at most SAMPLE
    own, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = posted.join(grid, "list").withColumn("block", own("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    asked = asked.join(grid, "list").withColumn("part", own("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")
    key = ["list", "block", "part"]
    found = posted.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    found = found.dropDuplicates(["query_id", "vec_id", "score"])
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
