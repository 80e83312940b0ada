"""Alignment of two tokenisers: which tokens of the one cover which tokens of the other, over a whole corpus.

Equal texts are brought together first, by a shuffle of whole texts that combines copies inside each task; each distinct
text is encoded and aligned once, and its pairs weigh as much as it has copies. Where no token of either side can reach
over a space that follows another character, which is looked up in the files, the equal words of a batch of texts are
encoded and aligned together. Byte offsets where tokens of both sides end
cut a text into groups; all tokens of the one side of a group are linked with all of the other. A pair of ids counts the
documents that hold it linked.

Counts come back to the texts in two ways: the most frequent pairs (``COMMON`` of them at most, so a broadcast of them is
bounded) are looked up in the tasks, all others are joined, once for each text that holds one. The measures go back to the
documents by the SHA-256 of their texts.

Defined results: a text that is null, empty, or that one side does not spell back byte for byte has no tokens: its
measures are 0, its groups ''. Every row is a document, rows of one id too, and rows without an id. Very long texts are
whole. An empty table gives an empty one. Other columns are left out unless they are named.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.llm.arrays import KEPT, chunks, distinct, release, spread_runs
from moodtide.llm.settings import bounded_batches
from moodtide.session import scratch_path

#: Pairs that are broadcast at most.
COMMON = 1 << 20
#: Words that are encoded in one call.
_TOGETHER = 4096
#: A space that ends a word: not after white space, and not the last character.
_SPACE = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
_OTHER_SPACE = re.compile(r"\s | \Z|\A ")
#: Links of a group up to which they are listed one by one; above it equal ids of a side are counted first.
_LISTED = 1 << 12


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def words(text: str) -> list[str]:
    """A text cut at the spaces that follow another character; joined by spaces again they are the text."""
    return _SPACE.split(text) if _OTHER_SPACE.search(text) else text.split(" ")


class Side:
    """One tokeniser: the bytes of each id, the ids of words, and whether it encodes the words of a text one by one."""

    def __init__(self, spelled: list[bytes], by_words: bool):
        self.size, self.by_words = len(spelled), by_words
        self.spelled = pa.array(spelled, pa.binary())
        self.lengths = np.array([len(s) for s in spelled], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text behind a space, each text on its own."""
        raise NotImplementedError

    def flat(self, texts: list[str], plain: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the place of each text's first (one more entry at the end).

        The first ``plain`` texts end in no space, so they are encoded joined, and cut where their bytes end.
        """
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for lo in range(0, len(texts), _TOGETHER):
            some = texts[lo : lo + _TOGETHER]
            found = self._together(some) if lo + len(some) <= plain else None
            if found is None:
                one_by_one = self.encode(some)
                found = np.array([i for one in one_by_one for i in one], np.int64), np.array([len(one) for one in one_by_one])
            ids.append(found[0])
            counts.append(found[1])
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids and how many each text has; None where the bytes of the ids do not end with the texts."""
        ids = np.array(self.encode([" ".join(texts)])[0], np.int64)
        ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([1 + len(t.encode()) for t in texts])
        places = np.searchsorted(ends, wanted)
        if places[-1] >= len(ends) or not np.array_equal(ends[places], wanted):
            return None
        return ids, np.diff(places, prepend=-1)

    def joined(self, ids: np.ndarray) -> bytes:
        return _joined(self.spelled, ids)


class ByteLevel(Side):
    """A byte-level BPE; its splitting rule never takes a space after another character into the same token."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        rules = json.loads(file)
        special = {t["id"] for t in rules["added_tokens"]}
        alphabet = byte_alphabet()
        spelled = []
        for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True)):
            entry = self.tokenizer.id_to_token(i)
            spelled.append(entry.encode() if i in special else bytes(alphabet[c] for c in entry))
        split = rules["pre_tokenizer"]
        super().__init__(spelled, rules["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A piece model that puts a space before each text."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        super().__init__(spelled, not any(re.search("[^▁]▁", p) for p in pieces))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _joined(table: pa.Array, at: np.ndarray) -> bytes:
    """The entries at the given places, joined."""
    taken = table.take(pa.array(at))
    if not len(taken):
        return b""
    offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset)
    return taken.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()


class Aligner:
    """Both tokenisers; built once in each Python worker."""

    _built: dict[tuple[bytes, bytes], Aligner] = {}

    @classmethod
    def of(cls, a: bytes, b: bytes) -> Aligner:
        if (a, b) not in cls._built:
            cls._built.clear()
            cls._built[a, b] = cls(a, b)
        return cls._built[a, b]

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        # each id as it is written inside a run of ids and at its end
        written = [f"{i}{mark}" for i in range(self.a.size) for mark in ",|"] + [f"{i}{mark}" for i in range(self.b.size) for mark in ",;"]
        self.written = pa.array(written, pa.binary())
        self.written_lengths = np.array([len(w) for w in written], np.int64)

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Measures of each text, its groups as written, and its distinct pairs: where they begin, their codes and numbers.

        The code of a pair is its first id times the size of the second vocabulary plus its second id.
        """
        cut = [words(t) for t in texts] if self.a.by_words and self.b.by_words else [[t] for t in texts]
        at = np.cumsum([0] + [len(c) for c in cut])
        word, found = distinct([w for c in cut for w in c])
        alone = np.array([not w or w[-1].isspace() or "▁" in w for w in found])  # would run into the space of a next word
        order = np.argsort(alone, kind="stable")
        word = np.argsort(order)[word]
        plain = int((~alone).sum()) if self.a.by_words and self.b.by_words else 0
        fine, measures, written, edges, codes, times = self._align([found[i] for i in order.tolist()], plain)
        wrong = np.concatenate([[0], np.cumsum(~fine[word])])[at]
        word, at = _only(word, at, np.diff(wrong) == 0)

        measures = {name: np.diff(np.concatenate([[0], np.cumsum(values[word])])[at]) for name, values in measures.items()}
        lengths = np.diff(np.frombuffer(written.buffers()[1], np.int32, len(written) + 1))
        data = _joined(written, word)
        ends = np.concatenate([[0], np.cumsum(lengths[word])])[at].tolist()
        lines = [data[lo : hi - 1] if hi > lo else b"" for lo, hi in zip(ends, ends[1:])]

        wide = self.a.size * self.b.size
        sizes = np.diff(edges)[word]
        held = spread_runs(edges[:-1][word], sizes)
        keys = codes[held] + np.repeat(np.repeat(np.arange(len(texts)), np.diff(at)), sizes) * wide
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        counts = np.add.reduceat(times[held[order]], first) if len(first) else np.zeros(0, np.int64)
        keys = keys[first]
        return measures, lines, np.searchsorted(keys, np.arange(len(texts) + 1) * wide), keys % wide, counts

    def _align(self, texts: list[str], plain: int) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts both sides spell back; measures, groups as written with a semicolon behind them, and pairs."""
        a, a_at = self.a.flat(texts, plain)
        b, b_at = self.b.flat(texts, plain)
        fine = self._spelled_back([(" " + t).encode() for t in texts], a, a_at, b, b_at)
        a, a_at = _only(a, a_at, fine)
        b, b_at = _only(b, b_at, fine)

        a_end, b_end = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        total = int(a_end[-1]) if len(a_end) else 0
        ends = np.zeros(total + 1, np.uint8)
        ends[a_end] += 1
        ends[b_end] += 1
        a_last, b_last = ends[a_end] == 2, ends[b_end] == 2
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        groups = int(a_last.sum())
        in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        group_at = np.concatenate([[0], np.cumsum(a_last)])[a_at]  # texts end where a group does
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])

        measures = {
            "n_a": np.diff(a_at),
            "n_b": np.diff(b_at),
            "n_groups": np.diff(group_at),
            "n_links": np.diff(links[group_at]),
        }
        written = self._written(a, b, a_group, b_group, a_last, b_last, in_a, in_b, a_at, b_at)
        return fine, measures, written, *self._pairs(a, b, a_group, in_a, in_b, group_at, len(texts))

    def _spelled_back(self, raw: list[bytes], a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
        whole = b"".join(raw)
        by_a, by_b = self.a.joined(a), self.b.joined(b)
        sizes = np.array([len(r) for r in raw])
        fine = np.ones(len(raw), bool)
        for side, spelled, ids, at in ((self.a, by_a, a, a_at), (self.b, by_b, b, b_at)):
            ends = np.concatenate([[0], np.cumsum(side.lengths[ids])])[at]
            if spelled == whole and np.array_equal(np.diff(ends), sizes):
                continue
            for i, given in enumerate(raw):
                fine[i] &= spelled[ends[i] : ends[i + 1]] == given
        return fine & (sizes > 1)  # an empty text is the space alone

    def _written(self, a, b, a_group, b_group, a_last, b_last, in_a, in_b, a_at, b_at) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3;`` of each text: decimal ids in order."""
        order = np.empty(len(a) + len(b), np.int64)
        a_before, b_before = np.cumsum(in_a), np.cumsum(in_b) - in_b
        order[np.arange(len(a)) + (b_before[a_group] if len(a) else 0)] = 2 * a + a_last
        order[np.arange(len(b)) + (a_before[b_group] if len(b) else 0)] = 2 * self.a.size + 2 * b + b_last
        data = _joined(self.written, order)
        ends = np.concatenate([[0], np.cumsum(self.written_lengths[order])])[a_at + b_at]
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])

    def _pairs(self, a, b, a_group, in_a, in_b, group_at, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = self.a.size * self.b.size
        text_of = np.repeat(np.arange(texts), np.diff(group_at))
        a_first, b_first = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        listed = in_a * in_b <= _LISTED
        mine = listed[a_group] if len(a) else np.zeros(0, bool)
        group = a_group[mine]
        times = in_b[group]
        codes = np.repeat(a[mine], times) * self.b.size + b[spread_runs(b_first[group], times)]
        codes += np.repeat(text_of[group], times) * wide
        codes, counts = np.unique(codes, return_counts=True)
        for g in np.flatnonzero(~listed):
            left, n_left = np.unique(a[a_first[g] : a_first[g] + in_a[g]], return_counts=True)
            right, n_right = np.unique(b[b_first[g] : b_first[g] + in_b[g]], return_counts=True)
            more = (text_of[g] * wide + left[:, None] * self.b.size + right).ravel()
            codes, back = np.unique(np.concatenate([codes, more]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.outer(n_left, n_right).ravel()])).astype(np.int64)
        edges = np.searchsorted(codes, np.arange(texts + 1) * wide)
        return edges, codes % wide, counts


KEPT["alignment"] = Aligner._built.clear


def _only(ids: np.ndarray, places: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts that are fine; the others have none."""
    if fine.all():
        return ids, places
    sizes = np.diff(places)
    return ids[np.repeat(fine, sizes)], np.concatenate([[0], np.cumsum(np.where(fine, sizes, 0))])


def _running(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair codes of a stored batch, their numbers, and the row of each."""
    steps, times = batch.column("steps"), batch.column("times")
    sizes = pc.list_value_length(steps).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(steps.flatten().to_numpy(), dtype=np.int64)])
    first = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    return sums[1:] - sums[first][row], times.flatten().to_numpy().astype(np.int64), row


def aligned_texts(docs: DataFrame, a: bytes, b: bytes, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row for each distinct text that has tokens, stored: its digest and number of copies, measures and pairs.

    ``a`` is the file of a byte-level BPE, ``b`` a piece model. ``steps`` are the differences of the sorted pair codes,
    ``times`` how often the text links each pair. ``keep_groups`` adds the groups themselves.
    """
    bounded_batches()
    spark = docs.sparkSession
    distinct = docs.select(F.col(text).alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    keyed = distinct.select(F.unhex(F.sha2("text", 256)).alias("text_hash"), "copies", "text")
    sides = Aligner.of(a, b)
    step = "int" if sides.a.size * sides.b.size < 1 << 31 else "long"
    kind = pa.int32() if step == "int" else pa.int64()
    more = ", groups string" if keep_groups else ""

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            measures, written, edges, codes, counts = Aligner.of(a, b).align(piece.column("text").to_pylist())
            begun = edges[:-1][np.diff(edges) > 0]
            steps = np.diff(codes, prepend=0)
            steps[begun] = codes[begun]
            offsets = pa.array(edges, pa.int32())
            columns = {
                "text_hash": piece.column("text_hash"),
                "copies": piece.column("copies"),
                **{name: pa.array(values, pa.int64()) for name, values in measures.items()},
                "groups_sha256": pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written]),
                "steps": pa.ListArray.from_arrays(offsets, pa.array(steps, kind)),
                "times": pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
            }
            if keep_groups:
                columns["groups"] = pa.array([w.decode() for w in written])
            yield pa.RecordBatch.from_pydict(columns)
            release(keep="alignment")

    schema = f"text_hash binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<{step}>, times array<int>{more}"
    path = scratch_path(spark, "aligned")
    rows = keyed.mapInArrow(measured, schema).withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def pair_counts(texts: DataFrame, second: int) -> DataFrame:
    """``pair, n, best`` of every linked pair: its documents, and whether no pair of its first id has more; stored.

    ``second`` is the size of the second vocabulary.
    """
    spark = texts.sparkSession

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, row = _running(batch)
            pairs, back = np.unique(codes, return_inverse=True)
            weights = batch.column("copies").to_numpy()[row]
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, back, weights)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
            release(keep="alignment")

    counts = texts.select("copies", "steps", "times").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    plain = scratch_path(spark, "pair-counts")
    counts.write.parquet(plain)
    counts = spark.read.parquet(plain).withColumn("first", F.expr(f"pair div {second}"))
    most = counts.groupBy("first").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))  # a row an id


def _common(pairs: DataFrame) -> tuple[int, dict[str, np.ndarray]]:
    """The least count of the pairs that are looked up in the tasks, and these pairs in order."""
    level = F.floor(F.log2("n")).cast("int")
    levels = sorted(((r["level"], r["count"]) for r in pairs.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, room = 64, COMMON
    for at, count in levels:
        room -= count
        if room < 0:
            break
        least = at
    chosen = pairs.where(F.col("n") >= F.lit(2.0) ** least).select("pair", "n", "best").toArrow()
    order = np.argsort(chosen.column("pair").to_numpy())
    found = {name: chosen.column(name).to_numpy()[order] for name in ("pair", "n", "best")}
    return least, found


def measures(docs: DataFrame, a: bytes, b: bytes, columns: list[str], text: str = "text", keep_groups: bool = False) -> DataFrame:
    """``columns`` of each row of ``docs`` and the measures of its text.

    ``n_a, n_b, n_groups, n_links``; ``n_best``: links whose count is the highest of their first id; ``count_sum``: the
    counts of all links; ``groups_sha256``, and with ``keep_groups`` the ``groups``.
    """
    spark = docs.sparkSession
    texts = aligned_texts(docs, a, b, text, keep_groups)
    pairs = pair_counts(texts, Aligner.of(a, b).b.size)
    _, table = _common(pairs)
    common = spark.sparkContext.broadcast(table)

    def look(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = common.value["pair"]
        at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
        return at, known[at] == codes if len(known) else np.zeros(len(codes), bool)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, row = _running(batch)
            at, found = look(codes)
            at, times, row = at[found], times[found], row[found]
            n, best = common.value["n"][at], common.value["best"][at]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[best], times[best])
            np.add.at(sums[1], row, times * n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums[0]), pa.array(sums[1])], ["row", "n_best", "count_sum"])
            release(keep="alignment")

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, row = _running(batch)
            left = ~look(codes)[1]
            rows = batch.column("row").to_numpy()[row[left]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(codes[left]), pa.array(times[left])], ["row", "pair", "times"])
            release(keep="alignment")

    held = texts.select("row", "steps", "times")
    rare = held.mapInArrow(others, "row long, pair long, times long").join(pairs, "pair")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = held.mapInArrow(summed, "row long, n_best long, count_sum long").union(rare)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = texts.drop("copies", "steps", "times").join(sums, "row").drop("row")

    whole = docs.select(*columns, F.unhex(F.sha2(F.col(text), 256)).alias("_text_hash"))
    joined = whole.join(found, F.col("_text_hash") == F.col("text_hash"), "left")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    said = ["groups_sha256", *(["groups"] if keep_groups else [])]
    return joined.select(
        *columns,
        *[F.coalesce(found[c], F.lit(0)).cast("long").alias(c) for c in numbers],
        *[F.coalesce(found[c], F.lit("")).alias(c) for c in said],
    )
