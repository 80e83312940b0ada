"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Lookup has two tiers. Whole pre-tokens that are in the vocabulary are resolved, for all distinct
pre-tokens of a chunk at once, by a minimal perfect hash over the vocabulary; the stored key is
compared, so a foreign pre-token is never taken for a known one. A miss is merged from its bytes by
a heap of pairs over linked positions: lowest rank first, leftmost first among equal ranks.

A null text is encoded as the empty text, which has no ids. Null ids decode to null, an id outside
the vocabulary is an error. Special tokens are ordinary text. Rows, other columns and their order are
left alone.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.arrays import KEPT, mix64, release, spread_runs, string_hashes
from moodtide.llm.settings import bounded_batches

#: Merged words that a Python worker remembers, and ids that such a word has at most; results do not depend on them.
MEMO_WORDS, MEMO_IDS = 1 << 19, 6
#: Bytes of texts that are split and looked up together, and ids that are decoded together; pre-tokens are Python strings for a
#: while, and an id takes about 100 bytes.
PIECE_BYTES = 1 << 18
#: Misses that are merged over the same arrays.
_TOGETHER = 4096


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The whole rank file (below 2 MB), read by Spark where the path has a scheme, else from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path, "rb") as file:
        return file.read()


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of the basic plane, with its character classes written out; None if it uses others.

    The standard library looks such classes up in a bitmap, which takes half the time.
    """
    ranges = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = [m.span() for m in regex.finditer(name + "+", _PLANE)]
        ranges[name] = "".join(f"\\u{lo:04x}-\\u{hi - 1:04x}" for lo, hi in inside)
    out, at, in_class = [], 0, False
    while at < len(pattern):
        name = next((n for n in (*ranges, r"\S") if pattern.startswith(n, at)), pattern[at])
        if name == r"\S":
            if in_class:
                return None
            out.append(f"[^{ranges[chr(92) + 's']}]")
        elif name in ranges:
            out.append(ranges[name] if in_class else f"[{ranges[name]}]")
        elif name in "\\.&~":
            return None
        else:
            in_class = name == "[" or (in_class and name != "]")
            out.append(name)
        at += len(name)
    return re.compile("".join(out))


#: Every character of the basic plane at its own place; a space of no class stands for the surrogates.
_PLANE = "".join("\x00" if 0xD800 <= i <= 0xDFFF else chr(i) for i in range(0x10000))


class PerfectHash:
    """Minimal perfect hash of strings: levels of bit slots, where a key alone in its slot settles.

    Slot ranks number the keys 0 .. n-1. ``find`` gives each key's number; for a string that is not a
    key it gives any number or -1, so callers compare.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        left = np.arange(len(keys))
        hashes = string_hashes(pa.array(keys, pa.string()))
        if len(np.unique(hashes)) != len(keys):
            raise ValueError("two keys share a 64-bit hash")
        self.levels: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        done = 0
        while len(left):
            slots = max(1, int(room * len(left)))
            slot = self._slot(hashes[left], len(self.levels), slots)
            alone = np.bincount(slot, minlength=slots) == 1
            number = np.full(slots, -1, np.int32)
            number[alone] = done + np.arange(int(alone.sum()))
            settled = alone[slot]
            at = np.empty(int(alone.sum()), np.int64)
            at[number[slot[settled]] - done] = left[settled]
            self.levels.append(number)
            self.order.append(at)
            done += len(at)
            left = left[~settled]
        #: Position in ``keys`` of the key with each number.
        self.positions = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)

    @staticmethod
    def _slot(hashes: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mix64(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(slots)).astype(np.int64)

    def find(self, keys: pa.Array | np.ndarray) -> np.ndarray:
        return self.find_hashed(string_hashes(pa.array(keys, pa.string())))

    def find_hashed(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, number in enumerate(self.levels):
            if not len(left):
                break
            found = number[self._slot(hashes[left], level, len(number))]
            out[left[found >= 0]] = found[found >= 0]
            left = left[found < 0]
        return out


class Codec:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    _built: dict[tuple[bytes, str], Codec] = {}

    @classmethod
    def of(cls, ranks: bytes, pattern: str) -> Codec:
        key = (ranks, pattern)
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(ranks, pattern)
        return cls._built[key]

    def __init__(self, ranks: bytes, pattern: str):
        rows = [line.split() for line in ranks.splitlines() if line]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.pattern = regex.compile(pattern)
        self.plain = plain_pattern(pattern) or self.pattern
        whole = {}
        for token, rank in self.ids.items():
            try:
                whole[token.decode()] = rank
            except UnicodeDecodeError:  # part of a character: no whole pre-token is ever equal to it
                pass
        keys = np.array(list(whole), dtype=object)
        self.hash = PerfectHash(keys)
        self.keys = keys[self.hash.positions]
        self.key_texts = pa.array(self.keys, pa.string())
        self.key_ids = np.array(list(whole.values()), np.int32)[self.hash.positions]
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        #: For each left id: the id that it merges to with a right id.
        nothing: dict[int, int] = {}
        self.pairs: list[dict[int, int]] = [nothing] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                left, right = self.ids.get(token[:k]), self.ids.get(token[k:])
                if left is not None and right is not None:
                    if self.pairs[left] is nothing:
                        self.pairs[left] = {}
                    self.pairs[left][right] = rank
        self.none = max(self.ids.values()) + 1  # above all ranks
        self.two = np.full(1 << 16, self.none, np.int64)
        for token, rank in self.ids.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        size = max(self.ids.values()) + 1
        spelled = [b""] * size
        for token, rank in self.ids.items():
            spelled[rank] = token
        self.known = np.zeros(size, bool)
        self.known[list(self.ids.values())] = True
        self.token_len = np.array([len(t) for t in spelled], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self._forget()

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens that are not in the vocabulary, one after another, and how many each has.

        All bytes are linked in the same arrays, each piece has a heap of its own. ``rank_at`` holds the rank of the
        pair that begins at a linked position now; a heap entry of another rank is out of date, and a piece is done when
        no pair is left.
        """
        merges, push, pop, replace, heapify = self.pairs, heapq.heappush, heapq.heappop, heapq.heapreplace, heapq.heapify
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = np.array([len(p) for p in pieces])
        stops = np.cumsum(sizes)
        shift = 12 if sizes.max() < 1 << 12 else 40  # short entries are quicker to compare
        place = np.arange(len(raw))
        rank = np.append(self.two[(raw[:-1] << 8) | raw[1:]], self.none)
        rank[stops - 1] = self.none
        starts = np.append(0, stops[:-1])
        low = (1 << shift) - 1
        real = rank < self.none  # only pairs go into a heap
        entries = ((rank << shift) | (place - np.repeat(starts, sizes)))[real].tolist()
        until = np.cumsum(real)[stops - 1].tolist()
        rank_at, after, before = np.where(real, rank, -1).tolist(), place + 1, place - 1
        after[stops - 1] = -1
        before[starts] = -1
        after, before, ids = after.tolist(), before.tolist(), self.single[raw].tolist()
        begin = 0
        for lo, end in zip(starts.tolist(), until):
            heap = entries[begin:end]
            pairs, begin = end - begin, end
            heapify(heap)
            while pairs:
                entry = heap[0]
                rank, i = entry >> shift, lo + (entry & low)
                if rank_at[i] != rank:
                    pop(heap)
                    continue
                j = after[i]
                k = after[i] = after[j]
                if rank_at[j] >= 0:
                    pairs -= 1
                ids[i], ids[j], rank_at[j] = rank, -1, -1
                found = -1
                if k >= 0:
                    before[k] = i
                    found = merges[rank].get(ids[k], -1)
                rank_at[i] = found
                if found >= 0:
                    replace(heap, (found << shift) | (i - lo))
                else:
                    pairs -= 1
                    pop(heap)
                h = before[i]
                if h >= 0:
                    found = merges[ids[h]].get(rank, -1)
                    pairs += (found >= 0) - (rank_at[h] >= 0)
                    rank_at[h] = found
                    if found >= 0:
                        push(heap, (found << shift) | (h - lo))
        merged = np.array(ids, np.int32)
        kept = merged >= 0
        return merged[kept], np.diff(np.cumsum(kept)[stops - 1], prepend=0)

    def _forget(self) -> None:
        """An empty memory: the hash of the miss in each slot, its ids and how many they are."""
        self.memo = np.zeros(MEMO_WORDS, np.uint64)
        self.memo_ids, self.memo_counts = np.zeros((MEMO_WORDS, MEMO_IDS), np.int32), np.zeros(MEMO_WORDS, np.int8)

    def _remembered(self, tokens: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the tokens that the memory has, their ids one after another, and how many each has."""
        slot = (hashes % np.uint64(len(self.memo))).astype(np.int64)
        old = np.flatnonzero((self.memo[slot] == hashes) & (self.memo_counts[slot] > 0))
        counts = self.memo_counts[slot[old]].astype(np.int64)
        ids = self.memo_ids[slot[old]][np.arange(MEMO_IDS) < counts[:, None]]
        data, ends = self.decode(ids, np.append(0, np.cumsum(counts)))
        spelled = pa.BinaryArray.from_buffers(pa.binary(), len(old), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        if not spelled.equals(tokens.take(pa.array(old)).cast(pa.binary())):  # two tokens share a hash: merge them all
            return old[:0], ids[:0], counts[:0]
        return old, ids, counts

    def missed(self, tokens: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each token outside the vocabulary begin and how many they are; from memory or merged."""
        if len(self.memo) != MEMO_WORDS:
            self._forget()
        old, ids, old_counts = self._remembered(tokens, hashes)
        is_new = np.ones(len(tokens), bool)
        is_new[old] = False
        new = np.flatnonzero(is_new)
        fresh = tokens.take(pa.array(new)).cast(pa.binary())
        parts, sizes = [ids], [np.zeros(0, np.int64)]
        for lo in range(0, len(new), _TOGETHER):
            merged, each = self.merge(fresh.slice(lo, _TOGETHER).to_pylist())
            parts.append(merged)
            sizes.append(each)
        new_counts = np.concatenate(sizes)
        counts, starts = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
        counts[old], starts[old] = old_counts, np.cumsum(old_counts) - old_counts
        counts[new], starts[new] = new_counts, len(ids) + np.cumsum(new_counts) - new_counts
        flat = np.concatenate(parts)
        short = new[new_counts <= MEMO_IDS]
        slot = (hashes[short] % np.uint64(MEMO_WORDS)).astype(np.int64)
        last = len(slot) - 1 - np.unique(slot[::-1], return_index=True)[1]  # one token a slot
        short, slot = short[last], slot[last]
        row = np.repeat(np.arange(len(short)), counts[short])
        wide = np.zeros((len(short), MEMO_IDS), np.int32)
        wide[row, np.arange(len(row)) - np.repeat(np.cumsum(counts[short]) - counts[short], counts[short])] = flat[spread_runs(starts[short], counts[short])]
        self.memo[slot], self.memo_counts[slot], self.memo_ids[slot] = hashes[short], counts[short], wide
        return flat, starts, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the first id's place of each text (one more entry at the end)."""
        counts, tokens = [0], []
        for text in texts:
            text = text or ""
            tokens += (self.plain if text.isascii() or not _ASTRAL.search(text) else self.pattern).findall(text)
            counts.append(len(tokens))
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        del tokens
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        hashes = string_hashes(distinct)
        number = self.hash.find_hashed(hashes)
        same = pc.equal(self.key_texts.take(pa.array(np.maximum(number, 0))), distinct)
        hit = (number >= 0) & same.to_numpy(zero_copy_only=False)
        miss = np.flatnonzero(~hit)
        merged, starts, sizes = self.missed(distinct.take(pa.array(miss)), hashes[miss])
        lengths = np.ones(len(distinct), np.int64)
        lengths[miss] = sizes
        at = np.empty(len(distinct), np.int64)
        at[hit] = np.arange(int(hit.sum()))
        at[miss] = int(hit.sum()) + starts
        flat = np.concatenate([self.key_ids[number[hit]], merged])
        many = lengths[codes]
        places = np.concatenate([[0], np.cumsum(many)])[counts]
        return flat[spread_runs(at[codes], many)], places

    def decode(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.token_bytes[spread_runs(self.token_at[ids], lengths)], ends[places]


KEPT["bpe"] = Codec._built.clear


def _pieces(values: pa.Array, sizes: np.ndarray, limit: int = PIECE_BYTES) -> list[pa.Array]:
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1), len(values)]
    return [values.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def encode(text: Column, ranks: bytes, pattern: str) -> Column:
    """The ids of each text as array<int>; each match of ``pattern`` is encoded separately."""

    bounded_batches()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        release(keep="bpe")
        codec, out = Codec.of(ranks, pattern), []
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for piece in _pieces(texts, sizes):
            flat, places = codec.encode(piece.to_pylist())
            out.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat, pa.int32())))
        whole = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        del out
        release(keep="bpe")
        return whole

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, ranks: bytes, pattern: str) -> Column:
    """The bytes that each array of ids stands for."""

    bounded_batches()

    @F.arrow_udf("binary")
    def spelled(lists: pa.Array) -> pa.Array:
        release(keep="bpe")
        codec, out = Codec.of(ranks, pattern), []
        for piece in _pieces(lists, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)):
            lengths = pc.fill_null(pc.list_value_length(piece), 0).to_numpy(zero_copy_only=False)
            places = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            data, ends = codec.decode(piece.flatten().to_numpy(zero_copy_only=False), places)
            whole = data.tobytes()
            null = piece.is_null().to_pylist()
            out.append(pa.array([None if gone else whole[lo:hi] for lo, hi, gone in zip(ends, ends[1:], null)], pa.binary()))
        whole = pa.concat_arrays(out) if out else pa.array([], pa.binary())
        del out
        release(keep="bpe")
        return whole

    return spelled(ids)
