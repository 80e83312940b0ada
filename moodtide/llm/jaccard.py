"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its distinct word shingles. All sets are put into one order: shingles that are
common in the corpus last. Two sets that are similar enough share at least ``k`` of the first
n - o + k shingles of each, where n is a set's size and o the least overlap it can have with a similar set. A
document of common shingles lengthens its prefix (greater k) as long as the work it expects falls: a longer
prefix meets more sets, but a pair is only verified after more shared shingles. What a pair has to share
follows from both sizes and prefixes: all that it shares beyond the prefix that ends first lies in the rest of
that set, so c shared prefix shingles allow an overlap of c plus the greater rest at most (``_enough``).

How common a shingle is, is estimated from counts in a table of fixed size over all documents. The
estimate only chooses the order and k; whatever they are, no pair is lost.

Equal sets are one node. For each prefix shingle its nodes are first paired with one of them only, a few times with
different ones; the links found so join nodes to components. Then the pairs between different components are
listed, counted and verified. A pair within a component cannot change the result, so a group of
copies never turns into all its pairs.

Defined results: a null text or one without words has the empty set, is linked with nothing and is a
component of its own; fewer words than a shingle make one shingle of them all; repeated rows are one node;
rows with a null id take part, but no component is named by null unless it has nothing else; an empty table
gives an empty result. Sets and links are compared by 64-bit hashes, verification uses 48 bits of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.arrays import chunks, mix64, release, shingles, word_hashes
from moodtide.llm.components import components
from moodtide.llm.settings import bounded_batches
from moodtide.session import materialise, scratch_path, small_side

#: Counters that estimate how common a shingle is, greatest k, and the work of a verification in postings.
COUNTERS, MOST, VERIFY = 1 << 20, 4, 20
#: Times that nodes are paired with one centre for each shingle, before the rest is listed.
TURNS = 2
_SHIFT = np.uint64(44)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(batch.column("text").to_pylist())
    for lo, hi in zip(bounds, bounds[1:]):
        yield np.unique(shingles(words[lo:hi], size))


def _node(hashes: np.ndarray) -> int:
    """One number for a set."""
    sums = np.array([mix64(hashes).sum(dtype=np.uint64), mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64), len(hashes)], np.uint64)
    return int(mix64((sums * np.array([1, 3, 5], np.uint64)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def least_overlap(n: int, percent: int) -> int:
    """Least number of shingles that a set of ``n`` shares with a set at least ``percent`` % similar."""
    smaller = -(-n * percent // 100)
    return -(-percent * (n + smaller) // (100 + percent))


def prefix(hashes: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set; ``common`` has the estimated number of other documents by counter."""
    n, overlap = len(hashes), least_overlap(len(hashes), percent)
    met = common[(hashes >> _SHIFT).astype(np.int64)]
    order = np.lexsort((hashes, met))
    work = np.cumsum(met[order].astype(np.int64))
    best, k = None, 1
    for more in range(1, min(MOST, overlap) + 1):
        length = n - overlap + more
        cost = length + work[length - 1] + VERIFY * work[length - 1] / more
        if best is None or cost < best:
            best, k = cost, more
    return hashes[order[: n - overlap + k]]


def document_sets(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles, node of each row, and the counters summed over all rows; one pass over the texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)

        def rows(ids: list, n: list, nodes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(n), pa.int32())], ["doc_id", "n_shingles", "node", "slot"])

        for batch in chunks(batches):
            found = list(_sets(batch, size))
            yield rows(batch.column("doc_id").to_pylist(), [len(s) for s in found], [_node(s) for s in found])
            if any(map(len, found)):
                counters += np.bincount((np.concatenate(found) >> _SHIFT).astype(np.int64), minlength=COUNTERS)
        release()
        used = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.array(counters[used]), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32())], ["doc_id", "n_shingles", "node", "slot"])

    path = scratch_path(docs.sparkSession, "shingle-sets")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_shingles long, node long, slot int").write.parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    sums = stored.where("slot is not null").groupBy("slot").agg(F.sum("n_shingles").alias("n")).toArrow()  # COUNTERS rows at most
    counters = np.zeros(COUNTERS, np.int64)
    counters[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return stored.where("slot is null").drop("slot"), counters


def postings(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """token, node, n, rest (shingles beyond the prefix), pos (place in the node's order) for every prefix shingle of every node."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            tokens, nodes, sizes, lengths = [], [], [], []
            seen = set()
            for hashes in _sets(batch, size):
                if len(hashes) and (node := _node(hashes)) not in seen:
                    seen.add(node)
                    found = prefix(hashes, common, percent)
                    tokens.append(found)
                    nodes.append(node)
                    sizes.append(len(hashes))
                    lengths.append(len(found))
            if nodes:
                node, n = (np.repeat(np.array(c, t), lengths) for c, t in ((nodes, np.int64), (sizes, np.int32)))
                rest = n - np.repeat(np.array(lengths, np.int32), lengths)
                pos = np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])
                columns = [pa.array(np.concatenate(tokens).view(np.int64)), *map(pa.array, (node, n, rest, pos))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "rest", "pos"])
        release()

    return docs.select("doc_id", "text").mapInArrow(scan, "token long, node long, n int, rest int, pos int")


def _overlap(percent: int) -> Column:
    """Least overlap of two similar sets of n and m shingles."""
    return F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent) - 1e-9)


def _enough(shared: Column, percent: int) -> Column:
    """Whether a pair can be similar: n, m are the sizes, rest_a, rest_b what lies beyond the prefixes, ``shared`` counts prefix shingles."""
    overlap = _overlap(percent)
    return (shared + F.greatest("rest_a", "rest_b") >= overlap) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)


def verify(docs: DataFrame, representative: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; ``representative`` names a document of each node."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(needed.join(representative, "node"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = list(_sets(batch, size))
            packed = [(s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array(packed, pa.binary())], ["node", "hashes"])
        release()

    picked = docs.select("doc_id", "text").join(small_side(wanted.withColumnRenamed("doc_id", "_id")), F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = picked.select("doc_id", "text").mapInArrow(scan, "node long, hashes binary").dropDuplicates(["node"])

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        def numbers(data: bytes) -> np.ndarray:
            wide = np.zeros((len(data) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
            return wide.view("<u8").ravel()

        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            both = np.sort(np.concatenate([numbers(x), numbers(y)]))
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(both) - shared))
        return pa.array(out, pa.bool_())

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")
    return materialise(two.where(similar("of_a", "of_b")).select("a", "b"))


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again; smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _open(met: DataFrame, *facts: Column) -> DataFrame:
    """The postings of tokens that different components share, with ``facts`` of each token.

    The facts are aggregated in the tasks first and stored, so the join with them can split a common token.
    """
    ends = met.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *facts)
    return met.join(materialise(ends.where("lo < hi").drop("lo", "hi")), "token")


def link(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for each row of ``docs`` (doc_id, text)."""
    bounded_batches()
    rows, counters = document_sets(docs, size)
    common = np.maximum(0, counters - int(counters.mean())).astype(np.int32)  # above what chance puts into a counter
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = materialise(nodes)

    # postings that at least two nodes share
    met = _stored(postings(docs, size, percent, common), "all-postings").withColumn("component", F.col("node"))
    met = _stored(_open(met).dropDuplicates(["token", "node"]), "postings")
    # the node whose prefix others share most is a good first centre: an original rather than one of its copies
    score = met.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("n") - F.col("rest")).alias("p"))
    score = materialise(score.select("node", (F.col("c") / F.col("p")).alias("score")))
    met = met.join(score, "node")

    facts = [F.count(F.lit(1)).alias("shared"), *[F.min(c).alias(c) for c in ("n", "m", "rest_a", "rest_b")]]
    links = tested = classes = None
    for turn in range(TURNS):
        rank = F.struct(F.col("score") if not turn else F.xxhash64("node", F.lit(turn)), "node", "n", "rest", "component")
        met = _stored(_open(met, F.max(rank).alias("head")), "open-postings")
        stars = met.where("component <> head.component").select(
            F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b"),
            F.col("head.n").alias("n"), F.col("head.rest").alias("rest_a"), F.col("n").alias("m"), F.col("rest").alias("rest_b"),
        )
        stars = stars.groupBy("a", "b").agg(*facts).where(_enough(F.col("shared"), percent)).select("a", "b")
        stars = materialise(stars if tested is None else stars.join(tested, ["a", "b"], "left_anti"))
        tested = stars if tested is None else tested.union(stars)
        found = verify(docs, nodes, stars, size, percent)
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        classes = materialise(components(links, "a", "b"))
        met = met.drop("head", "component").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # what is left: all pairs between different components, but for those whose nodes share too little with anything
    left = _open(met.drop("head")).drop("score")
    counts = materialise(left.groupBy("node").agg(F.count(F.lit(1)).alias("c")))
    left = left.join(counts, "node")
    x = _stored(left.select("token", "node", "n", "rest", "pos", "component", "c"), "open-postings").withColumnsRenamed({"node": "a", "rest": "rest_a", "pos": "pos_a", "c": "c_a"})
    y = x.toDF(*[{"a": "b", "n": "m", "rest_a": "rest_b", "pos_a": "pos_b", "c_a": "c_b", "component": "other"}.get(c, c) for c in x.columns])
    pairs = x.join(y, "token").where("a < b and component <> other").where(_enough(F.least("c_a", "c_b"), percent))
    # the first shingle that two similar sets share stands early enough in both for the rest to be shared
    early = (F.col("pos_a") <= F.col("n") - _overlap(percent)) & (F.col("pos_b") <= F.col("m") - _overlap(percent))
    pairs = materialise(pairs.where(early).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
    found = verify(docs, nodes, pairs, size, percent)
    if not found.isEmpty():
        classes = materialise(components(found if links is None else links.union(found), "a", "b"))

    if classes is None:
        classes = nodes.select("node", F.col("node").alias("component")).limit(0)
    named = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialise(named.join(materialise(least), "component").select("node", "component_id"))
    out = rows.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
