"""Vocabulary and fixed-length token sequences for a text classifier."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.functions.text import vocabulary_tokens
from moodtide.session import BROADCAST_ROWS, materialise, small_side, with_global_position

#: Ids of the reserved tokens; words follow.
PAD, UNKNOWN, START, END = range(4)
RESERVED = 4


def build_vocab(df: DataFrame, text: str = "text", size: int | None = None) -> DataFrame:
    """Vocabulary ``(term, token_id, n)``: ids follow the reserved ones in order of falling frequency.

    With ``size`` only the most frequent terms are kept, found without a full sort. Without it all
    terms are numbered by a distributed sort.
    """
    counts = df.select(F.explode(vocabulary_tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("term")]
    if size is None:
        numbered = with_global_position(counts, order, "_at")
    else:
        top = counts.orderBy(*order).limit(size)
        numbered = top.withColumn("_at", F.row_number().over(W.orderBy(*order)) - 1)  # at most ``size`` rows
    return numbered.select("term", (F.col("_at") + RESERVED).cast("int").alias("token_id"), "n")


def _with_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens`` with the ``token_id`` of their ``term``, null where the vocabulary lacks it.

    A vocabulary beyond the broadcast bound is met in two parts: its most frequent words, which have the lowest ids, are
    broadcast, so that no task gets all rows of a common word; only the rows of the others are shuffled by word.
    """
    words = vocab.select("term", "token_id")
    if words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return tokens.join(F.broadcast(words), "term", "left")
    common = F.col("token_id") < RESERVED + BROADCAST_ROWS
    met = tokens.join(small_side(words.where(common), BROADCAST_ROWS), "term", "left")
    # a text without words has a null term and is not looked up
    settled = F.col("token_id").isNotNull() | F.col("term").isNull()
    rare = met.where(~settled).drop("token_id").join(words.where(~common), "term", "left")
    return met.where(settled).unionByName(rare)


def encode_sequence(
    df: DataFrame,
    vocab: DataFrame,
    maxlen: int,
    keys: Sequence[str] = ("id",),
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``input_ids`` and ``attention_mask``, both of length ``maxlen``, per text.

    Start mark, tokens, end mark, then padding; a longer text is cut so that the end mark fits.
    Only tokens that can appear in the result leave the row of their text.
    """
    by = [*keys, *carry]
    used = F.slice(vocabulary_tokens(F.col(text)), 1, maxlen - 2)
    tokens = df.select(*by, F.posexplode_outer(used).alias("_pos", "term"))
    ids = _with_ids(tokens, vocab).withColumn("_id", F.coalesce("token_id", F.lit(UNKNOWN)))
    placed = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_id"))
    sequences = ids.groupBy(*by).agg(F.array_sort(F.collect_list(placed)).alias("_tokens"))
    body = F.concat(F.array(F.lit(START)), F.col("_tokens._id"), F.array(F.lit(END)))
    padding = F.array_repeat(F.lit(PAD), F.lit(maxlen) - F.size("_tokens") - 2)
    encoded = sequences.select(*by, F.concat(body, padding).alias("input_ids"))
    return encoded.withColumn("attention_mask", F.transform("input_ids", lambda i: (i != PAD).cast("int")))


#: Marks a piece that goes on inside a word.
INSIDE = "##"


def with_characters(vocab: DataFrame) -> DataFrame:
    """``(term, token_id)`` of a vocabulary, and behind them each character of its terms, as a beginning and as a going-on piece.

    Ids follow those of the vocabulary in the order of the pieces; a few thousand characters meet in one task.
    """
    character = F.explode(F.array_distinct(F.split("term", "")))
    characters = vocab.select(character.alias("c")).where("c <> ''").distinct()
    pieces = characters.select(F.explode(F.array("c", F.concat(F.lit(INSIDE), F.col("c")))).alias("term")).join(vocab.select("term"), "term", "left_anti")
    last = vocab.agg(F.coalesce(F.max("token_id"), F.lit(RESERVED - 1)).alias("_last"))
    added = pieces.withColumn("_at", F.row_number().over(W.orderBy("term"))).crossJoin(F.broadcast(last))  # one row on the right
    return vocab.select("term", "token_id").union(added.select("term", (F.col("_last") + F.col("_at")).cast("int")))


def _split(word: str, pieces: dict[str, int], longest: int) -> list[int]:
    """The ids of the longest pieces from left to right; unknown as a whole where a place has none."""
    ids, at = [], 0
    while at < len(word):
        lead = INSIDE if at else ""
        for end in range(min(len(word), at + longest), at, -1):
            found = pieces.get(lead + word[at:end])
            if found is not None:
                break
        else:
            return [UNKNOWN]
        ids.append(found)
        at = end
    return ids


def split_words(words: DataFrame, pieces: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``(term, ids)`` for each distinct word of ``words(term)``: whole if it is a piece, else by its longest pieces.

    A piece that goes on inside a word begins with ``##``. ``pieces`` has ``most`` rows at most, since tasks hold it.
    """
    table = {r["term"]: r["token_id"] for r in pieces.limit(most + 1).collect()}
    if len(table) > most:
        raise ValueError(f"the vocabulary has more than {most} pieces")
    longest = max(map(len, table), default=0)
    shared = words.sparkSession.sparkContext.broadcast(table)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("term")
            ids = [_split(t, shared.value, longest) for t in terms.to_pylist()]
            yield pa.RecordBatch.from_arrays([terms, pa.array(ids, pa.list_(pa.int32()))], ["term", "ids"])

    return words.select("term").where("term is not null").distinct().mapInArrow(each, "term string, ids array<int>")


def encode_pieces(
    df: DataFrame,
    pieces: DataFrame,
    maxlen: int,
    keys: Sequence[str] = ("id",),
    text: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` like ``encode_sequence``, words outside the vocabulary cut into pieces.

    Each distinct word is cut once, whatever the number of texts that hold it.
    """
    by = [*keys, *carry]
    used = F.slice(vocabulary_tokens(F.col(text)), 1, maxlen - 2)  # a word has a piece at least
    tokens = materialise(df.select(*by, F.posexplode_outer(used).alias("_pos", "term")))
    cut = materialise(split_words(tokens, pieces))
    ids = tokens.join(small_side(cut), "term", "left")
    placed = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "ids"))
    sequences = ids.groupBy(*by).agg(F.slice(F.flatten(F.array_sort(F.collect_list(placed))["ids"]), 1, maxlen - 2).alias("_ids"))
    body = F.concat(F.array(F.lit(START)), F.col("_ids"), F.array(F.lit(END)))
    padding = F.array_repeat(F.lit(PAD), F.lit(maxlen) - F.size("_ids") - 2)
    encoded = sequences.select(*by, F.concat(body, padding).alias("input_ids"))
    return encoded.withColumn("attention_mask", F.transform("input_ids", lambda i: (i != PAD).cast("int")))
