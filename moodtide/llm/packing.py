"""Packing of documents into as few sequences of a fixed number of tokens as possible.

``pieces`` encodes texts and cuts those that are longer than a sequence. An instance of the packing is the number of pieces
of each length, at most as many numbers as a sequence has tokens, so it is solved on counts, many equal sequences at a
time (``plan``): Martello and Toth's reduction fixes small sets that provably dominate every other set with
their largest member, again and again until nothing more can be fixed, and best fit, longest first, packs the rest. Only
counts meet on the driver. ``pack`` numbers the pieces of each length inside the tasks that wrote them, so no sort and no
group holds a whole length, and looks the places up by length and number.

Defined results: a null text is empty and holds the end id alone. Rows of one id, repeated rows and rows without an id are
documents of their own. A very long text is cut, never dropped. An empty table gives an empty one. Which of equally long
pieces takes which place is left open. Columns that are not named are left out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.llm.arrays import KEPT, chunks, release, spread_runs
from moodtide.llm.settings import bounded_batches
from moodtide.session import scratch_path

#: Tokens of a sequence.
CAPACITY = 4096
#: Bits for the number of a piece among those of its length.
_RANK_BITS = 46

#: Texts of about so many bytes are encoded together, and words by one call.
_BATCH, _TOGETHER = 8_000_000, 4096
#: Words whose ids a Python worker remembers; a memory bound, results do not depend on it.
MEMO_WORDS = 300_000
#: A rule that cuts words at white space, drops it and lower-cases the rest: fixed values of the tokeniser files it stands in.
_WORDS = ["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words that keep their length in bytes under that rule.
_PLAIN = r"^[!-~\x{00A1}-\x{00FF}]+$"


class Encoder:
    """A tokeniser file; built once in each Python worker.

    Where its rule never reaches over a space, the equal words of a batch of texts are encoded once.
    """

    _built: dict[bytes, Encoder] = {}

    @classmethod
    def of(cls, file: bytes) -> Encoder:
        if file not in cls._built:
            cls._built.clear()
            cls._built[file] = cls(file)
        return cls._built[file]

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        rules = json.loads(file)
        self.special = [t["content"] for t in rules["added_tokens"]]
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
        splits = [p["pattern"].get("Regex") for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        suffix = rules["model"].get("end_of_word_suffix") or ""
        self.by_words = (steps, *splits) == _WORDS and suffix != "" and not any(" " in t for t in self.special)
        entries = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.lengths = np.array([len(e) - len(suffix) * e.endswith(suffix) for e in entries])  # a character stands for a byte
        self.known, self.known_ids, self.known_counts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids, and how many each word has; None where the bytes of the ids do not end with the words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in words])
        places = np.searchsorted(ends, wanted)
        if places[-1] >= len(ends) or not np.array_equal(ends[places], wanted):
            return None
        return ids, np.diff(places, prepend=-1)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each word begin and how many they are; new words are remembered while there is room."""
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        ids, fresh_counts = self._new(fresh)
        counts, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        counts[new], starts[new] = fresh_counts, len(self.known_ids) + np.cumsum(fresh_counts) - fresh_counts
        old = np.flatnonzero(at >= 0)
        counts[old], starts[old] = self.known_counts[at[old]], (np.cumsum(self.known_counts) - self.known_counts)[at[old]]
        flat = np.concatenate([self.known_ids, ids])
        room = MEMO_WORDS - len(self.known)
        if room > 0 and len(fresh):
            self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
            self.known_counts = np.concatenate([self.known_counts, fresh_counts[:room]])
            self.known_ids = flat[: int(self.known_counts.sum())]
        return flat, starts, counts

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for content in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, content))
        plain = plain.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        found: list[np.ndarray] = []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        listed = words.take(pa.array(order)).to_pylist()
        for lo in range(0, len(listed), _TOGETHER):
            some, at = listed[lo : lo + _TOGETHER], order[lo : lo + _TOGETHER]
            joined = self._together(some) if plain[at[-1]] else None
            if joined is None:
                each = self._each(some)
                joined = np.concatenate(each), np.array([len(e) for e in each])
            found.append(joined[0])
            counts[at] = joined[1]
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found or [np.zeros(0, np.uint32)])[spread_runs(starts, counts)], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the place of each text's first (one more entry at the end); a null text is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            each = self._each(texts.to_pylist())
            return np.concatenate(each or [np.zeros(0, np.uint32)]), np.cumsum([0] + [len(e) for e in each])
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        ids, firsts, counts = self._distinct(coded.dictionary)
        many = counts[word]
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        return ids[spread_runs(firsts[word], many)], np.concatenate([[0], np.cumsum(many)])[at]


KEPT["packing"] = Encoder._built.clear


def pieces(
    docs: DataFrame, file: bytes, columns: list[str], capacity: int = CAPACITY, end_id: int = 1, text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """``columns``, ``piece, start, length, ids_crc32`` of every piece of every document, and with ``keep_ids`` its ``ids``.

    ``file`` is the content of a tokeniser file; ``end_id`` follows the ids of each text.
    """
    bounded_batches()
    given = docs.select(*columns, F.col(text).alias("_text"))
    more = ", ids array<int>" if keep_ids else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text", _BATCH):
            ids, at = Encoder.of(file).encode(batch.column("_text"))
            ids = np.insert(ids, at[1:], np.uint32(end_id))  # one behind each text
            at = at + np.arange(len(at))
            lengths = np.diff(at)
            many = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = at[row] + piece * capacity
            end = np.minimum(begin + capacity, at[row + 1])
            data = memoryview(ids.astype("<u4").tobytes())
            named = {name: batch.column(name).take(pa.array(row)) for name in columns}
            named |= {
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(piece * capacity, pa.int64()),
                "length": pa.array(end - begin, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(data[4 * lo : 4 * hi]) for lo, hi in zip(begin.tolist(), end.tolist())], pa.int64()),
            }
            if keep_ids:
                named["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(named)
            release(keep="packing")

    return given.mapInArrow(cut, f"{schema}, piece int, start long, length long, ids_crc32 long{more}")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of ``counts[length]`` pieces of each length has fewer sequences (Martello and Toth's second bound)."""
    sizes = np.arange(len(counts))
    total = np.concatenate([[0], np.cumsum(counts * sizes)]).tolist()
    many = np.concatenate([[0], np.cumsum(counts)]).tolist()
    best = ceil(total[-1] / capacity)
    for small in range(capacity // 2 + 1):
        # pieces above capacity - small take a sequence each, those above half one each, the middle ones fill what is left
        half = capacity // 2
        alone, large = many[-1] - many[capacity - small + 1], many[capacity - small + 1] - many[half + 1]
        room = capacity * large - (total[capacity - small + 1] - total[half + 1])
        middle = total[half + 1] - total[min(small, half + 1)]
        best = max(best, alone + large + max(0, ceil((middle - room) / capacity)))
    return best


def dominating(counts: np.ndarray, size: int, capacity: int) -> list[int] | None:
    """The others of a set that dominates all sets with a piece of ``size``, or None where no rule decides.

    ``counts[length]`` pieces are open. Either no other piece fits, or at most one does, or the largest fills
    the rest, or at most two fit and a largest one, or a largest one with the largest that fits beside it, stands for all.
    """
    counts = counts.copy()
    counts[size] -= 1
    there = np.flatnonzero(counts)
    left = capacity - size
    if not len(there) or there[0] > left:
        return []
    largest = int(there[np.searchsorted(there, left, "right") - 1])
    if largest == left:
        return [largest]
    least = np.repeat(there[:3], np.minimum(counts[there[:3]], 3))[:3]
    if len(least) < 2 or least[0] + least[1] > left:
        return [largest]
    if len(least) == 3 and least.sum() <= left:
        return None
    # exactly two fit: the two of largest sum
    partner = np.searchsorted(there, left - there, "right") - 1
    partner = np.minimum(partner, np.arange(len(there)))  # the second is not the larger
    twice = (partner == np.arange(len(there))) & (counts[there] < 2)
    partner[twice] -= 1
    sums = np.where(partner >= 0, there + there[np.maximum(partner, 0)], -1)
    sums[sums > left] = -1
    most = int(sums.max())
    if largest >= most:
        return [largest]
    first = int(np.flatnonzero(sums == most)[-1])  # of equal sums the one with the largest member
    second = int(partner[first])
    if there[first] != largest:
        return None
    between = np.repeat(there[second + 1 : first][:2], np.minimum(counts[there[second + 1 : first][:2]], 2))[:2]
    if len(between) < 2 or between.sum() > left:
        return [largest, int(there[second])]
    return None


def reduce(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Sequences that some best packing has, as (lengths and how many of each, how many such sequences).

    Their pieces are taken out of ``counts``. A set stays dominating while it can be taken again, so it is taken as often as its
    pieces last.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for size in np.flatnonzero(counts)[::-1].tolist():
            while counts[size]:
                others = dominating(counts, size, capacity)
                if others is None:
                    break
                needed = {size: 1}
                for other in others:
                    needed[other] = needed.get(other, 0) + 1
                times = min(int(counts[s]) // n for s, n in needed.items())
                for s, n in needed.items():
                    counts[s] -= n * times
                fixed.append((sorted(needed.items(), reverse=True), times))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, of ``counts[length]`` pieces; equal sequences are filled together."""
    open_: list[list[tuple[list[tuple[int, int]], int]]] = [[] for _ in range(capacity + 1)]  # by the room that is left
    some = np.zeros(capacity + 1, bool)

    def put(filled: list[tuple[int, int]], room: int, many: int) -> None:
        if many:
            open_[room].append((filled, many))
            some[room] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = size + int(np.argmax(some[size:]))
            if some[room]:
                filled, many = open_[room].pop()
                some[room] = bool(open_[room])
            else:
                filled, many, room = [], left, capacity
            each = min(room // size, left)
            whole = min(many, left // each)
            put([*filled, (size, each)], room - each * size, whole)
            left -= whole * each
            if whole < many and left and left < each:  # the last one takes fewer
                put([*filled, (size, left)], room - left * size, 1)
                whole, left = whole + 1, 0
            if filled:
                put(filled, room, many - whole)
    return [group for groups in open_ for group in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces go: runs of pieces of one length, in the order of length and number.

    A run begins at piece number ``rank`` of ``length``; ``each`` of its pieces stand behind one another in every sequence,
    from ``offset`` on, and its first sequence is ``sequence``.
    """
    counts = np.array(counts, np.int64)
    groups = reduce(counts, capacity)
    groups += best_fit(counts, capacity)
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for filled, many in groups:
        offset = 0
        for size, each in filled:
            rank = used.get(size, 0)
            runs.append((size, rank, each, offset, sequence))
            used[size] = rank + each * many
            offset += size * each
        sequence += many
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "offset", "sequence"), table.T)) | {"sequences": np.int64(sequence)}


def length_counts(rows: DataFrame, capacity: int, length: str = "length") -> np.ndarray:
    """The number of pieces of each length up to ``capacity``."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy(length).count().collect():  # one row a length
        if not 0 < row[length] <= capacity:
            raise ValueError(f"a piece of {row[length]} tokens does not go into a sequence of {capacity}")
        counts[row[length]] = row["count"]
    return counts


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (pieces with a ``length``), each with its ``sequence_id`` and its ``offset`` there."""
    spark, names = rows.sparkSession, rows.columns
    path = scratch_path(spark, "pieces")
    rows.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_task", F.shiftright("_row", 33))  # the id keeps the task above 33 bits
    counts = stored.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_task", "length").orderBy("_row")) - 1
    numbered = stored.withColumn("_inside", inside).join(first, ["_task", "length"])
    ready = numbered.select(*names, (F.col("_first") + F.col("_inside")).alias("_rank"))
    runs = spark.sparkContext.broadcast(plan(length_counts(stored, capacity), capacity))  # bounded by the capacity alone

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs.value["length"] << _RANK_BITS | runs.value["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1
            inside, each = rank - runs.value["rank"][at], runs.value["each"][at]
            more = [pa.array(runs.value["sequence"][at] + inside // each), pa.array(runs.value["offset"][at] + inside % each * length)]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ready.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of every sequence, from packed pieces with their ``ids``; a group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
