"""Document fingerprints by locally consistent parsing.

Level by level, runs of equal symbols become one symbol, deterministic coin tossing reduces the symbols
to a few labels whose neighbours differ, a phrase begins at every local maximum of the labels, and a
phrase is named by a hash of its symbols; the names are the next level's symbols. Where a phrase begins
depends on a few neighbouring symbols alone, so equal substrings get the same phrases but near their
ends, wherever they stand. The names of the levels from ``LOWEST`` up form the signature set of a text; a
one-permutation min-hash of that set is the fingerprint, and the share of equal places estimates the
likeness (Jaccard) of two sets.

Defined results: a null text is the empty text; the empty text's fingerprint is all zero, it is like
another empty text (1) and unlike all others (0). Equal texts have equal fingerprints. Texts of any
length are parsed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.llm.arrays import chunks, mix64, release
from moodtide.llm.settings import bounded_batches

#: Lowest level whose phrases count, highest level, and places of a fingerprint (two bytes each).
LOWEST, HIGHEST, PLACES = 2, 6, 128
#: Documents of a bucket (about) and most buckets when rows are ordered by id.
BUCKET_ROWS, BUCKETS = 500, 4096
_K = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)
_ROWS = 4096


def _toss(label: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from its left neighbour, plus that bit's value."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[head] = label[head] ^ _ONE
    differ = label ^ left
    at = np.bitwise_count((differ & (~differ + _ONE)) - _ONE).astype(np.uint64)
    return (at << _ONE) | ((label >> np.minimum(at, np.uint64(63))) & _ONE)


def next_level(names: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of all texts, and the first phrase of each; ``head`` has the first symbol of each text."""
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[head] = True
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(names))).astype(np.uint64)
    symbols = names[starts]
    symbols = np.where(runs > 1, mix64(symbols + runs * _K), symbols)
    head = np.searchsorted(starts, head)
    label = symbols
    for _ in range(3):
        label = _toss(label, head)
    peak = np.zeros(len(symbols), bool)
    peak[1:] = label[1:] > label[:-1]
    peak[:-1] &= label[:-1] >= label[1:]
    peak[head] = True
    first = np.flatnonzero(peak)
    length = np.diff(np.append(first, len(symbols)))
    place = (np.arange(len(symbols)) - np.repeat(first, length)).astype(np.uint64)
    total = np.add.reduceat(mix64(symbols + place * _K), first)
    return mix64(total + length.astype(np.uint64)), np.searchsorted(first, head)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One row of ``PLACES`` numbers for each text; 0 stands for an empty place."""
    out = np.zeros((len(texts), PLACES), np.uint16)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    names = mix64(np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le"), np.uint32).astype(np.uint64) + _K)
    lengths = np.array([len(texts[i]) for i in full])
    head = np.cumsum(lengths) - lengths
    kept = []
    for level in range(1, HIGHEST + 1):
        names, head = next_level(names, head)
        if level >= LOWEST:
            owner = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(np.append(head, len(names))))
            kept.append((owner << np.uint64(51)) | (mix64(names) >> np.uint64(13)))  # text, then 7 bits of place, then 44 of rank
    keys = np.sort(np.concatenate(kept))
    place = keys >> np.uint64(44)
    least = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    value = (mix64(keys[least] & np.uint64((1 << 44) - 1)) % np.uint64(65535) + _ONE).astype(np.uint16)
    where = place[least].astype(np.int64)
    out[np.array(full)[where // PLACES], where % PLACES] = value
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint of each text, as bytes."""

    bounded_batches()

    @F.arrow_udf("binary")
    def parse(texts: pa.Array) -> pa.Array:
        out = []
        for batch in chunks([pa.RecordBatch.from_arrays([texts], ["text"])]):
            for lo in range(0, batch.num_rows, _ROWS):
                out += [row.tobytes() for row in fingerprints(batch.column(0).slice(lo, _ROWS).to_pylist()).astype(">u2")]
        release()
        return pa.array(out, pa.binary())

    return parse(F.coalesce(text, F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common signatures of two fingerprints, from 0 to 1."""

    @F.arrow_udf("double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint16).reshape(-1, PLACES) for v in (left, right))
        used = ((x > 0) | (y > 0)).sum(axis=1)
        return pa.array(np.where(used > 0, ((x == y) & (x > 0)).sum(axis=1) / np.maximum(used, 1), 1.0))

    return compare(a, b)


def with_next(docs: DataFrame, key: str, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """Add to each row the ``columns`` of the next one by ascending ``key`` (after the last the first) as next_*.

    ``derived`` columns are computed once per row, from its own columns, and carried over likewise.

    Buckets of neighbouring keys are cut at quantiles, so one shuffle brings neighbours together and no task
    orders the whole table. A bucket also gets the first row of the one that follows. Null keys come first, equal
    keys are ordered by ``columns``.
    """
    n = docs.count()
    probabilities = np.linspace(0, 1, min(BUCKETS, max(1, n // BUCKET_ROWS)) + 1)[1:-1].tolist()
    numbers = docs.select(F.col(key).cast("double").alias("_key")).where("_key is not null")
    cuts = sorted(set(numbers.approxQuantile("_key", probabilities, 0.25 / (len(probabilities) + 1)))) if probabilities else []
    bucketed = docs.withColumn("_key", F.col(key).cast("double"))
    if cuts:
        cutter = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_key", outputCol="_bucket", handleInvalid="keep")
        bucketed = cutter.transform(bucketed.withColumn("_key", F.coalesce("_key", F.lit(-float("inf"))))).withColumn("_bucket", F.col("_bucket").cast("int"))
    else:
        bucketed = bucketed.withColumn("_bucket", F.lit(0))
    bucketed = bucketed.drop("_key").withColumn("_extra", F.lit(0))
    firsts = bucketed.groupBy("_bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("first"))).alias("m")).collect()  # BUCKETS rows
    order = sorted(r["_bucket"] for r in firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    if not order:
        docs = docs.withColumns(derived or {})
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in [*columns, *(derived or {})]])
    heads = docs.sparkSession.createDataFrame(
        [(r["m"]["first"], before[r["_bucket"]]) for r in firsts], f"_first {docs.schema[key].dataType.simpleString()}, _to int"
    )
    best = W.partitionBy("_to").orderBy(*columns)
    extra = (
        bucketed.drop("_bucket").join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("_first")))
        .withColumn("_nth", F.row_number().over(best)).where("_nth = 1")
        .withColumn("_bucket", F.col("_to")).withColumn("_extra", F.lit(1)).select(*bucketed.columns)
    )
    line = W.partitionBy("_bucket").orderBy("_extra", F.col(key).asc_nulls_first(), *columns)
    both = bucketed.unionByName(extra).withColumns(derived or {})
    return both.withColumns({f"next_{c}": F.lead(c).over(line) for c in [*columns, *(derived or {})]}).where("_extra = 0").drop("_bucket", "_extra")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the beginning of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
