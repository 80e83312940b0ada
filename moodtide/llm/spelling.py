"""Spelling variants: words of a vocabulary that one edit separates, and the common form that each leads to.

``vocabulary`` counts the words of all texts. ``group`` builds Bloom filters of the vocabulary, sharded by word
length and cut into parts of a bounded number of words; every word's deletions are probed against the filters of the
length below, its replacements against those of its own length (insertions are the deletions of the other word, and of
two words that a replacement separates the one with the lower code point probes). Hashes of all edits follow from the
word's own, so no edit is spelled out unless a filter says yes; those few are joined with the vocabulary, which
drops the false positives. A pass over the words holds ``PASS_BYTES`` of filters at most; a larger vocabulary takes
several passes, each over the words whose lengths its filters concern.

Defined results: null texts and null words have no words; an empty table gives an empty one. Every row of a text
counts, repeated rows too. Counts of a word that is given twice are added up. Ties of the most frequent near word go to
the smallest in code-point order. Words of any length are whole. Further columns of the texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.arrays import mix64, release
from moodtide.llm.settings import bounded_batches
from moodtide.session import materialise

#: Runs that are words, before their A-Z are lower-cased.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words of one filter part, bits that each has in it, and bytes of filters that a pass holds.
PART_WORDS, BITS, PASS_BYTES = 1 << 15, 16, 64 << 20
#: Edits whose hashes are held at once.
_PROBES = 1 << 20
_P = 0xD6E8FEB86659FD93  # odd, so that powers have inverses
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))
_SALT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(words: DataFrame, word: str = "word", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """``word, n`` of all words (one row an occurrence) with so many code points and occurrences at least."""
    kept = words.where(F.char_length(word) >= least_length).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return kept.where(F.col("n") >= least_count)


def runs(text: Column, pattern: str = RUN) -> Column:
    """The maximal runs of letters of a text, A-Z lower-cased."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, capitals, capitals.lower()), F.lit(pattern), F.lit(0))


def shard(length: np.ndarray | int) -> np.ndarray:
    """The shard of a length: its own below 64, then one for each power of two."""
    length = np.asarray(length)
    return np.where(length < 64, length, 58 + np.floor(np.log2(np.maximum(length, 1))).astype(np.int64))


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) * _SALT + np.uint64(1))


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, np.uint64(_P))
    out[0] = 1
    return np.multiply.accumulate(out)


def _sealed(sums: np.ndarray, length: int) -> np.ndarray:
    return mix64(sums + np.uint64(length * int(_SALT) % (1 << 64)))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words of each length, and their code points as a matrix."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(at) and lengths[at[0]]:
            joined = "".join([words[i] for i in at]).encode("utf-32-le")
            yield at, np.frombuffer(joined, np.uint32).reshape(len(at), -1)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of words of one length."""
    length = codes.shape[1]
    return _sealed((_values(codes) * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length)


def _bits(hashed: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The block of each hash, and two of its eight words with four bits in each."""
    block = ((mix64(hashed ^ _SALT) >> np.uint64(32)) * blocks) >> np.uint64(32)
    halves = []
    for half in range(2):
        word = (hashed >> np.uint64(3 * half)) & np.uint64(7)
        mask = np.zeros(len(hashed), np.uint64)
        for field in range(4):
            mask |= np.uint64(1) << ((hashed >> np.uint64(6 + 6 * (4 * half + field))) & np.uint64(63))
        halves.append((word, mask))
    return block, halves


def build(hashed: np.ndarray) -> np.ndarray:
    """A blocked Bloom filter of the hashes: blocks of eight 64-bit words."""
    blocks = max(1, ceil(len(hashed) * BITS / 512))
    bits = np.zeros(blocks * 8, np.uint64)
    block, halves = _bits(hashed, np.uint64(blocks))
    for word, mask in halves:
        np.bitwise_or.at(bits, (block * np.uint64(8) + word).astype(np.int64), mask)
    return bits


def holds(bits: np.ndarray, hashed: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Which hashes may be in their filter, the ``blocks`` of ``bits`` from ``first`` on; none that is in it is missed."""
    block, halves = _bits(hashed, blocks)
    block += first
    left = np.arange(len(hashed))
    for word, mask in halves:
        at = (block[left] * np.uint64(8) + word[left]).astype(np.int64)
        left = left[(bits[at] & mask[left]) == mask[left]]
    out = np.zeros(len(hashed), bool)
    out[left] = True
    return out


def part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    return (((mix64(hashed) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


class Filters:
    """The filter parts of one pass by shard, one behind another, and the letters of each shard."""

    def __init__(self, bits: dict[tuple[int, int], np.ndarray], parts: dict[int, int], letters: dict[int, np.ndarray]):
        self.letters, self.bits, self.first, self.blocks = letters, {}, {}, {}
        for of in letters:
            held = [bits.get((of, p), np.zeros(0, np.uint64)) for p in range(parts[of])]
            self.bits[of] = np.concatenate(held)
            self.blocks[of] = np.array([len(b) // 8 for b in held], np.uint64)
            self.first[of] = np.cumsum(self.blocks[of], dtype=np.uint64) - self.blocks[of]

    def probe(self, of: int, hashed: np.ndarray) -> np.ndarray:
        """Which hashes may be words of shard ``of`` whose part this pass holds."""
        part = part_of(hashed, len(self.blocks[of]))
        blocks = self.blocks[of][part]
        here = np.flatnonzero(blocks)
        out = np.zeros(len(hashed), bool)
        out[here] = holds(self.bits[of], hashed[here], self.first[of][part[here]], blocks[here])
        return out

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Rows of ``codes`` (words of one length) and an edit of each that may be a word."""
        length = codes.shape[1]
        rows = max(1, _PROBES // length)
        for lo in range(0, len(codes), rows):
            piece = codes[lo : lo + rows]
            for row, edits in self._edits(piece, length):
                yield row + lo, edits

    def _edits(self, codes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, list[str]]]:
        powers = _powers(length)
        terms = _values(codes) * powers[:length]
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        sums = before[:, -1]
        below, own = int(shard(length - 1)), int(shard(length))
        if below in self.letters:
            gone = before - terms + (sums[:, None] - before) * _INVERSE
            once = np.ones(codes.shape, bool)  # of a run of equal letters only the last is deleted
            once[:, :-1] = codes[:, :-1] != codes[:, 1:]
            row, place = np.nonzero(once)
            found = self.probe(below, _sealed(gone[row, place], length - 1))
            row, place = row[found], place[found]
            if len(row):
                kept = np.ones((len(row), length), bool)
                kept[np.arange(len(row)), place] = False
                yield row, _spelled(codes[row][kept].reshape(len(row), length - 1))
        if own in self.letters:
            for letter in self.letters[own]:
                row, place = np.nonzero(codes < letter)
                change = _values(np.array([letter]))[0] * powers[:length]
                found = self.probe(own, _sealed(sums[row] + change[place] - terms[row, place], length))
                row, place = row[found], place[found]
                if len(row):
                    edited = codes[row]
                    edited[np.arange(len(row)), place] = letter
                    yield row, _spelled(edited)


def _spelled(codes: np.ndarray) -> list[str]:
    """The words of a matrix of code points."""
    joined, length = np.ascontiguousarray(codes, np.uint32).tobytes().decode("utf-32-le"), codes.shape[1]
    return [joined[i : i + length] for i in range(0, len(joined), length)]


def filters(words: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``shard, part, bits, letters`` of the vocabulary, stored, and the number of parts of each shard."""
    length = F.char_length("word")
    counted = words.groupBy(F.when(length < 64, length).otherwise(58 + F.floor(F.log2(length))).cast("int").alias("shard")).count()
    parts = {row["shard"]: ceil(row["count"] / PART_WORDS) for row in counted.collect()}  # some eighty shards

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, codes in by_length(batch.column("word").to_pylist()):
                keys, of = hashes(codes), int(shard(codes.shape[1]))
                letters = np.unique(codes).astype(np.int32)
                fields = [
                    pa.array(np.full(len(at), of, np.int32)),
                    pa.array(part_of(keys, parts[of]).astype(np.int32)),
                    pa.array(keys.view(np.int64)),
                    # the letters of all words of the batch, beside the first of each part of it
                    pa.array([letters] + [None] * (len(at) - 1), pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(fields, ["shard", "part", "hash", "letters"])
            release()

    def built(table: pa.Table) -> pa.Table:
        bits = build(table.column("hash").to_numpy().view(np.uint64))
        letters = table.column("letters").combine_chunks().flatten().unique()
        row = [table.column("shard")[0].as_py(), table.column("part")[0].as_py()]
        return pa.table(
            {
                "shard": pa.array(row[:1], pa.int32()),
                "part": pa.array(row[1:], pa.int32()),
                "bits": pa.array([bits.tobytes()], pa.binary()),
                "letters": pa.array([letters.to_pylist()], pa.list_(pa.int32())),
            }
        )

    keys = words.select("word").mapInArrow(hashed, "shard int, part int, hash long, letters array<int>")
    table = keys.groupBy("shard", "part").applyInArrow(built, "shard int, part int, bits binary, letters array<int>")
    return materialise(table), parts


def _passes(sizes: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of filter parts of ``PASS_BYTES`` at most together, in the order of their shards."""
    some, room = [], PASS_BYTES
    for of, part, size in sorted(sizes):
        if some and size > room:
            yield some
            some, room = [], PASS_BYTES
        some.append((of, part))
        room -= size
    if some:
        yield some


def near(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b`` for every two words of ``word, n`` that one edit separates, each pair once.

    ``words`` is stored or cheap, and holds a word once.
    """
    bounded_batches()
    spark = words.sparkSession
    table, parts = filters(words)
    letters: dict[int, np.ndarray] = {}
    sets = table.groupBy("shard").agg(F.array_distinct(F.flatten(F.collect_list("letters"))).alias("letters"))
    for row in sets.collect():  # some eighty rows with the letters that their words have
        letters[row["shard"]] = np.array(sorted(row["letters"]), np.uint32)
    sizes = [(r["shard"], r["part"], r["size"]) for r in table.select("shard", "part", F.length("bits").alias("size")).collect()]

    found = None
    for held in _passes(sizes):
        wanted = F.col("shard").between(held[0][0], held[-1][0])
        rows = {(r["shard"], r["part"]): r["bits"] for r in table.where(wanted).select("shard", "part", "bits").collect() if (r["shard"], r["part"]) in held}
        bits = {key: np.frombuffer(bytes(value), np.uint64) for key, value in rows.items()}
        shards = {of for of, _ in held}
        one = spark.sparkContext.broadcast(Filters(bits, parts, {of: letters[of] for of in shards}))
        length = F.char_length("word")
        least, most = min(shards), max(shards)
        low = least if least < 64 else 1 << (least - 58)
        high = most if most < 64 else (1 << (most - 57)) - 1
        concerned = words.where(length.between(low, high + 1))

        def edits(batches: Iterable[pa.RecordBatch], filters=one) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for at, codes in by_length(texts):
                    for row, spelled in filters.value.candidates(codes):
                        mine = at[row]
                        fields = [pa.array([texts[i] for i in mine], pa.string()), pa.array(counts[mine]), pa.array(spelled, pa.string())]
                        yield pa.RecordBatch.from_arrays(fields, ["a", "n_a", "b"])
                release()

        some = concerned.select("word", "n").mapInArrow(edits, "a string, n_a long, b string")
        found = some if found is None else found.union(some)
    if found is None:  # no words, no filters
        found = spark.createDataFrame([], "a string, n_a long, b string")
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "n_a", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``word, form`` lead in the end.

    Counts grow tenfold at every step, so the paths are short, and their length halves in every round.
    """
    roots = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialise(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if step.where("_moved").limit(1).count() == 0:
            return step.select("word", "root")
        roots = step.select("word", "root")


def group(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``word, n``.

    ``form`` is the near word of largest ``n``, if that is ``ratio`` times the word's own at least; ``root`` is where the
    forms lead in the end, the word itself where it has none.
    """
    given = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    given = materialise(given)
    pairs = materialise(near(given))
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    common = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    table = materialise(
        given.join(best, "word", "left").select(
            "word",
            F.when(common, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(table.where("form is not null"))
    out = table.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
