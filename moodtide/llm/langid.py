"""Language identification by language-bitmask n-gram filters.

A language owns the letter trigrams that make up at least ``MIN_SHARE`` of its training text and are
not far more common elsewhere. One table holds the Bloom filters of all languages, bit-sliced: a slot has
one bit per language, so ANDing the few slots of a trigram yields all languages that own it. A text's
bits are counted per language, the count expected from false positives is taken off, and the language
with the most left is chosen (the first by code point among equals).

Training counts come from all labelled rows. The filter's size is bounded: a language owns at most
1 / MIN_SHARE trigrams, whatever the corpus.

Defined results: ``und`` with score 0 for a null text, a text without a letter, and for every text when
there was nothing to learn from. Null labels teach nothing. The score is the corrected share of the
text's trigrams that the chosen language owns.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.llm.arrays import chunks, mix64, release
from moodtide.llm.settings import bounded_batches

#: Least share of a language's trigrams that a trigram needs, and least part of its largest share in any language.
MIN_SHARE, MIN_PART = 1e-5, 0.1
HASHES, SLOTS_PER_GRAM = 3, 16
#: Distinct trigrams that a training task holds before it passes its counts on; a memory bound only.
HELD_GRAMS = 1_000_000
#: Bytes of texts whose trigrams are looked up together; each byte takes about 120 for a while.
TEXT_BYTES = 250_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter or mark, else a space."""
    out = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] in "LM":
            out[point] = ord(char.lower()[0])
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams around every letter of all texts, packed into 64 bits, and the text that each belongs to."""
    texts = [t or "" for t in texts]
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in texts)])
    code = _letters()[points]
    space = code == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # one space after each word
    keep[0] = True
    code, owner = code[keep].astype(np.uint64), owner[keep]
    centre = np.flatnonzero(code[1:-1] != 32) + 1
    packed = (code[centre - 1] << np.uint64(42)) | (code[centre] << np.uint64(21)) | code[centre + 1]
    return packed, owner[centre] - 1


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of ``labelled`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(place, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.view(np.int64), "n": n})
            held.clear()

        release()  # what an earlier task of another operator left goes before there is more
        for batch in chunks(batches, limit=TEXT_BYTES):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                grams, _ = trigrams([t for t, x in zip(texts, langs) if x == lang])
                if len(grams):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(grams, return_counts=True))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_GRAMS:
                yield from emit()
        yield from emit()
        release()

    bounded_batches()
    counted = labelled.where("lang is not null and text is not null").select("text", "lang")
    return counted.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    """Bit-sliced Bloom filters of all languages."""

    langs: list[str]
    table: np.ndarray  # slots x bytes, one bit per language
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for k in range(HASHES):
            found = self.table[(mix64(grams + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(len(self.table) - 1)).astype(np.int64)]
            out = found if out is None else out & found
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        if not self.langs or not len(grams):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = np.unpackbits(self.masks(grams), axis=1, bitorder="little", count=len(self.langs))
        hits = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(n)
        hits[some] = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        own = np.maximum(0, hits - n[:, None] * self.false_rate) / (1 - self.false_rate)
        best = own.argmax(axis=1)
        score = np.where(n > 0, own[np.arange(len(texts)), best] / np.maximum(n, 1), 0)
        letter = [any(map(str.isalpha, t or "")) for t in texts]
        return [self.langs[b] if has else UNKNOWN for b, has in zip(best, letter)], np.where(letter, np.minimum(score, 1), 0)


def fit(labelled: DataFrame) -> Filters:
    """Filters from all rows of ``labelled`` (text, lang)."""
    counts = count_trigrams(labelled)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))  # a row per language
    shares = shares.where(F.col("share") >= MIN_SHARE)
    most = F.max("share").over(W.partitionBy("gram"))
    owned = shares.withColumn("most", most).where(F.col("share") >= MIN_PART * F.col("most")).select("lang", "gram").toArrow()
    langs = sorted(set(owned.column("lang").to_pylist()), key=lambda x: [ord(c) for c in x])
    number = {lang: i for i, lang in enumerate(langs)}
    grams = owned.column("gram").to_numpy().view(np.uint64)
    of = np.array([number[x] for x in owned.column("lang").to_pylist()], np.int64)
    slots = 1 << int(np.ceil(np.log2(max(1024, SLOTS_PER_GRAM * len(np.unique(grams))))))
    table = np.zeros((slots, max(1, (len(langs) + 7) // 8)), np.uint8)
    for k in range(HASHES):
        slot = (mix64(grams + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(slots - 1)).astype(np.int64)
        np.bitwise_or.at(table, (slot, of // 8), (1 << (of % 8)).astype(np.uint8))
    fill = np.unpackbits(table, axis=1, bitorder="little", count=len(langs)).mean(axis=0) if langs else np.zeros(0)
    return Filters(langs, table, fill**HASHES)


def predict_batch(texts: pa.Array, filters: Filters) -> pa.Array:
    """struct<lang, score> of each text of a batch."""
    release()  # what an earlier task of another operator left goes before there is more
    langs, scores = [], []
    for batch in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], limit=TEXT_BYTES):
        found, score = filters.predict(batch.column(0).to_pylist())
        langs += found
        scores.append(score)
    flat = np.concatenate(scores) if scores else np.zeros(0)
    release()
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(flat, pa.float64())], ["lang", "score"])


def predict(text: Column, filters: Filters) -> Column:
    """struct<lang, score> of each text."""

    bounded_batches()

    @F.arrow_udf("struct<lang: string, score: double>")
    def language(texts: pa.Array) -> pa.Array:
        return predict_batch(texts, filters)

    return language(text)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds
