"""Scoring texts by an n-gram model with deleted interpolation.

A word's probability mixes its share after the word before it, its share in the corpus, and an equal share
for every known word and the unknown one. How much each counts depends on how often the word before was
seen: contexts are put into buckets by the power of two of their count, and each bucket's weights are learned
by expectation-maximisation on documents whose counts are held out (a tenth of the training documents, by
hash). The final counts are those of all training documents.

Counts are exact and cover every text. They are exchanged in packed runs: a task takes texts of about
``BATCH_BYTES``, sends the sorted distinct keys of its words and word pairs to the tasks that own their
ranges, which add them up over the corpus and send each batch its own keys' totals back. So a common word
costs one entry per batch, no task holds more than its key range, and nothing that grows is broadcast.

The input is read three times and must list its rows in the same partitions and order each time, as a stored
table does; a batch that differs between readings is an error, not a wrong score. Materialise other frames.

Defined results: a null text is the empty text, which is scored as its end alone; without training texts every
known count is 0 and the model is the equal share; a bucket that the held-out part does not reach takes the weights
of the next lower one; repeated rows are scored and counted each. A null id is in the fold of the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.arrays import mix64, pack, unpack, word_hashes
from moodtide.llm.settings import bounded_batches
from moodtide.session import scratch_path

#: Text of a batch, text per key range, rounds of expectation-maximisation, steps of log2 in its table of counts.
BATCH_BYTES, RANGE_BYTES, ROUNDS, STEPS = 4_000_000, 8_000_000, 60, 8
#: Parts of the documents: scored only, counted, counted but held out while the weights are learned.
SCORED, COUNTED, HELD = 0, 1, 2
#: Weights (pair, word, equal share) where nothing was held out.
DEFAULT = (0.5, 0.4, 0.1)
BUCKETS = 48
_END, _START = np.uint64(0x1F0E2D3C4B5A6978), np.uint64(0x7766554433221100)
_BASE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of all texts, ends included: key of the word, of its context, of the pair; and each text's first token."""
    words, bounds = word_hashes(texts)
    n = len(texts)
    ends = bounds[1:] + np.arange(n)
    token = np.empty(len(words) + n, np.uint64)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = words, _END
    first = np.concatenate([[0], ends + 1])
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first[:-1]] = _START
    return mix64(token ^ _WORD), mix64(context ^ _WORD), mix64(mix64(context * _BASE) + token), first


_START_KEY = mix64(np.array([_START ^ _WORD]))[0]


class Keys:
    """The sorted distinct keys of a batch: words (with the start) and pairs."""

    def __init__(self, texts: list[str | None]):
        word, context, pair, self.first = token_keys(texts)
        start = np.array([_START_KEY])
        self.words, at = np.unique(np.concatenate([word, start]), return_inverse=True)
        self.word_at = at[:-1]
        self.context_at = np.searchsorted(self.words, context)
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)

    def counts(self, parts: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """How often the words (texts for the start) and pairs occur in the texts of one part."""
        of = np.repeat(parts == part, np.diff(self.first))
        words = np.bincount(self.word_at[of], minlength=len(self.words))
        words[np.searchsorted(self.words, _START_KEY)] += int((parts == part).sum())
        return words, np.bincount(self.pair_at[of], minlength=len(self.pairs))


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number the texts of a task in batches, those of the held-out part apart."""
    task = TaskContext.get().partitionId()
    waiting: dict[bool, list[pa.Table]] = {False: [], True: []}
    size, number = {False: 0, True: 0}, {False: 0, True: 0}

    def take(kind: bool) -> tuple[int, pa.Table]:
        out = (task << 32) | (number[kind] << 1) | kind, pa.concat_tables(waiting[kind])
        waiting[kind], size[kind], number[kind] = [], 0, number[kind] + 1
        return out

    for batch in stream:
        held = pc.equal(batch.column("part"), HELD)
        for kind in (False, True):
            rows = pa.Table.from_batches([batch.filter(held if kind else pc.invert(held))])
            sizes = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy()
            at = 0
            while at < len(rows):
                fits = int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES - size[kind], side="right"))
                piece = rows.slice(at, max(fits, 0 if waiting[kind] else 1))
                if len(piece):
                    waiting[kind].append(piece)
                    size[kind] += int(sizes[at : at + len(piece)].sum())
                    at += len(piece)
                if at < len(rows):
                    yield take(kind)
    for kind in (False, True):
        if waiting[kind]:
            yield take(kind)


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """First key of each range, and the end."""
    tops = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, tops), [len(keys)]])


_SENT = "range int, batch long, kind int, n int, keys binary, counted binary, held binary"


def _send(docs: DataFrame, bits: int) -> DataFrame:
    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in batches(stream):
            keys = Keys(rows.column("text").to_pylist())
            parts = rows.column("part").to_numpy()
            out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
            counted, held = keys.counts(parts, COUNTED), keys.counts(parts, HELD)
            for kind, values in enumerate((keys.words, keys.pairs)):
                edges = _ranges(values, bits)
                for number, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    if hi > lo:
                        run = values[lo:hi]
                        row = number, batch, kind, hi - lo, pack(np.diff(run, prepend=np.uint64(0))), pack(counted[kind][lo:hi].astype(np.uint32)), pack(held[kind][lo:hi].astype(np.uint32))
                        for column, value in zip(out.values(), row):
                            column.append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counted", pa.binary()), ("held", pa.binary())]))

    return docs.select("text", "part").mapInArrow(send, _SENT)


_TOTALS = "range int, batch long, kind int, n int, tokens long, distinct long, counted binary, total binary"


def _add_up(rows: pa.Table) -> pa.Table:
    """Corpus totals of one key range, as one answer to each batch and one row (batch -1) of the range's own sums."""
    out: dict[str, list] = {c.split()[0]: [] for c in _TOTALS.split(", ")}
    number = rows.column("range")[0].as_py()

    def add(*row) -> None:
        for column, value in zip(out.values(), row):
            column.append(value)

    for kind in (0, 1):
        own = rows.filter(pc.equal(rows.column("kind"), kind))
        if not len(own):
            continue
        n = own.column("n").to_pylist()
        data = {c: own.column(c).to_pylist() for c in ("keys", "counted", "held")}
        keys = np.concatenate([np.cumsum(unpack(d, m, np.uint64), dtype=np.uint64) for d, m in zip(data["keys"], n)])
        distinct, at = np.unique(keys, return_inverse=True)
        del keys
        sums = [np.bincount(at, np.concatenate([unpack(d, m, np.uint32) for d, m in zip(data[c], n)]), len(distinct)).astype(np.int64) for c in ("counted", "held")]
        counted, total = sums[0], sums[0] + sums[1]
        end = 0
        for batch, m in zip(own.column("batch").to_pylist(), n):
            mine = at[end : end + m]
            end += m
            add(number, batch, kind, m, 0, 0, pack(counted[mine].astype(np.uint32)) if batch & 1 else b"", pack(total[mine].astype(np.uint32)))
        if kind == 0:
            real = distinct != _START_KEY
            add(number, -1, 0, 0, int(total[real].sum()), int((total[real] > 0).sum()), b"", b"")
            add(number, -2, 0, 0, int(counted[real].sum()), 0, b"", b"")
    return pa.table(out, schema=pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("counted", pa.binary()), ("total", pa.binary())]))


def _answers(keys: Keys, answer: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The totals of a batch's words and pairs, in the order of its keys."""
    found = []
    for kind, size in enumerate((len(keys.words), len(keys.pairs))):
        own = answer.filter(pc.equal(answer.column("kind"), kind)).sort_by("range")
        if sum(own.column("n").to_pylist()) != size:
            raise ValueError("a batch changed between two readings of the documents; materialise them first")
        parts = [unpack(d, m, np.uint32) for d, m in zip(own.column(column).to_pylist(), own.column("n").to_pylist())]
        found.append(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
    return found[0], found[1]


def _buckets(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def _with_batches(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "text": "string", "part": "int"}

    def number(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in batches(stream):
            yield from rows.append_column("batch", pa.array([batch] * len(rows), pa.int64())).combine_chunks().to_batches()

    return docs.select(*kinds).mapInArrow(number, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", batch long")


def learn_weights(table: np.ndarray) -> np.ndarray:
    """Weights (bucket, pair / word / equal share) from rows (bucket, pair share, word share, equal share, n)."""
    weights = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    weights[0] = [0, *(np.array(DEFAULT[1:]) / sum(DEFAULT[1:]))]
    for bucket in range(BUCKETS):
        own = table[table[:, 0] == bucket]
        if not len(own):
            if bucket > 1:
                weights[bucket] = weights[bucket - 1]
            continue
        w = weights[bucket].copy()
        for _ in range(ROUNDS):
            part = own[:, 1:4] * w
            w = (part / part.sum(1, keepdims=True) * own[:, 4:]).sum(0) / own[:, 4].sum()
            w = np.maximum(w, [0 if bucket == 0 else 1e-6, 1e-6, 1e-6])
            w /= w.sum()
        weights[bucket] = w
    return weights


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    base_score is the smoothed word model, score the mixed model; both log10 of the text's probability.
    """
    spark = docs.sparkSession
    bounded_batches()
    tenth = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(10)) == 0
    part = F.when(train, F.when(tenth, HELD).otherwise(COUNTED)).otherwise(SCORED).cast("int")
    docs = docs.select("doc_id", "text", part.alias("part"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))
    path = scratch_path(spark, "totals")
    _send(docs, bits).groupBy("range").applyInArrow(_add_up, _TOTALS).write.parquet(path)
    totals = spark.read.parquet(path)
    sums = {r["batch"]: (r["t"], r["v"]) for r in totals.where("batch < 0").groupBy("batch").agg(F.sum("tokens").alias("t"), F.sum("distinct").alias("v")).collect()}
    tokens, known = sums.get(-1, (0, 0))
    counted_tokens = sums.get(-2, (0, 0))[0]
    answers = totals.where("batch >= 0").select("range", "batch", "kind", "n", "counted", "total")

    def shares(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return pair / np.maximum(context, 1), word / max(n, 1)

    def tabulate(rows: pa.Table, answer: pa.Table) -> pa.Table:
        keys = Keys(rows.column("text").to_pylist())
        words, pairs = _answers(keys, answer, "counted")
        context = words[keys.context_at]
        by_pair, by_word = shares(words[keys.word_at], context, pairs[keys.pair_at], counted_tokens)
        step = lambda p: np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-30)) * STEPS), -9999).astype(np.int64)
        cells, n = np.unique(np.stack([_buckets(context), step(by_pair), step(by_word)], axis=1), axis=0, return_counts=True)
        return pa.table({"bucket": cells[:, 0], "pair": cells[:, 1], "word": cells[:, 2], "n": n.astype(np.int64)})

    held = _with_batches(docs.where(F.col("part") == HELD)).groupBy("batch")
    cells = held.cogroup(answers.where("batch % 2 = 1").groupBy("batch")).applyInArrow(tabulate, "bucket long, pair long, word long, n long")
    cells = cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toArrow()  # bounded by the steps
    bucket, pair, word, n = (cells.column(c).to_numpy().astype(float) for c in ("bucket", "pair", "word", "n"))
    back = lambda x: np.where(x > -9999, 2.0 ** (x / STEPS), 0)
    weights = learn_weights(np.stack([bucket, back(pair), back(word), np.full(len(n), 1 / (known + 1)), n], axis=1))

    def scores(rows: pa.Table, answer: pa.Table) -> pa.Table:
        keys = Keys(rows.column("text").to_pylist())
        words, pairs = _answers(keys, answer, "total")
        word, context = words[keys.word_at], words[keys.context_at]
        by_pair, by_word = shares(word, context, pairs[keys.pair_at], tokens)
        w = weights[_buckets(context)]
        first = keys.first[:-1]
        mixed = np.log10(w[:, 0] * by_pair + w[:, 1] * by_word + w[:, 2] / (known + 1))
        base = np.log10((word + 0.5) / (tokens + 0.5 * (known + 1)))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": pc.equal(rows.column("part"), SCORED),
                "n_tokens": np.diff(keys.first),
                "n_known": np.add.reduceat((word > 0).astype(np.int64), first),
                "base_score": np.add.reduceat(base, first),
                "score": np.add.reduceat(mixed, first),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _with_batches(docs).groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
