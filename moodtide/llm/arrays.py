"""Small numpy helpers shared by the operators: batching of texts, word hashes, ragged gathers, packing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of about so many bytes are worked on together; one longer text forms a chunk of its own.
CHUNK_BYTES = 2_000_000

_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a piece have about ``limit`` bytes; no row is cut or left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and the first word of each text (one more entry at the end).

    Words are runs of other bytes than space and 9 to 13. A null text has no words.
    """
    coded = [(t or "").encode() for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    begins = np.cumsum([0] + [len(t) + 1 for t in coded])
    inside = ~_SPACE[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    bounds = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = np.flatnonzero(before & ~inside) - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.add.reduceat(_BYTE[_LOWER[raw[inside]]] * powers[at], first)
    return mix64(sums + lengths.astype(np.uint64)), bounds


def string_hashes(strings: pa.Array) -> np.ndarray:
    """Hashes of whole strings, none of them null."""
    lengths = pc.binary_length(strings).to_numpy().astype(np.int64)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset)
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    powers = np.full(int(lengths.max()) + 1, _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    first = offsets[:-1].astype(np.int64) - offsets[0]
    sums = np.zeros(len(lengths), np.uint64)
    filled = lengths > 0
    if filled.any():
        sums[filled] = np.add.reduceat(_BYTE[raw] * powers[np.arange(len(raw)) - np.repeat(first, lengths)], first[filled])
    return mix64(sums + lengths.astype(np.uint64) * _M1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words make one hash of the whole sequence, none make none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = mix64(out * _BASE + words[k : k + n])
    return out


def distinct(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The number of each word among the distinct ones, and these."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def spread_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs one after another: starts[0], starts[0]+1, ..., starts[1], ..."""
    out = np.cumsum(lengths) - lengths
    return np.repeat(starts - out, lengths) + np.arange(int(lengths.sum()))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What modules keep in a worker between tasks, by name: how to forget it.
KEPT: dict[str, Callable[[], None]] = {}


def release(keep: str = "") -> None:
    """Give free memory of a Python worker back, and what other operators than ``keep`` have left in it.

    A worker serves later tasks, of other operators too, and shares its executor's limit.
    """
    for name, forget in KEPT.items():
        if name != keep:
            forget()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def pack(values: np.ndarray) -> bytes:
    """Numbers of one type as compressed bytes, plane by plane."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpack(data: bytes, count: int, kind: type) -> np.ndarray:
    if not count:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, count * width, "zstd", asbytes=True), np.uint8).reshape(width, count)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
