"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The targets of the sources are cut into blocks of ``block_words`` words. Blocks go to sources by the
highest quotients target / (2k + 1), and a source's blocks go to its shards by the same rule with the
shards' words as weights. A shard lines its documents up in seeded order; its blocks are consecutive
runs of that line. It takes whole passes and then a run of blocks that starts at a seeded place and
wraps round, so nearly all documents are taken whole.

The highest quotients are not listed one by one: seats that are certain follow from a divisor, and
only the last few seats, at most two for each party, are ranked (``apportion``).

Defined results: a null text has size 0, a null source is a source of its own and sorts last, a
document of size 0 is taken 0 times, repeated rows are separate documents, an empty table gives an
empty result, and a source smaller than half a block may receive nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.session import materialise, small_side

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: Words of a block, documents of a shard (about), and the seed of all orders and starts.
BLOCK_WORDS, SHARD_DOCUMENTS, SEED = 16, 10_000, "mix-1"


def words_in(text: Column) -> Column:
    """Number of words; null has none.

    Each word with the space behind it becomes one letter, and the letters are counted: no array of all words is made.
    """
    letters = F.regexp_replace(F.regexp_replace(text, WORD + SPACE + "*+", "x"), "^" + SPACE + "+", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def seeded(seed: str, *parts: Column) -> Column:
    """A number below 2^32 that depends on the seed and the parts alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: its words, documents and target.

    ``sizes`` has source, size. Sources by code point, null last, take the weights in turn and divide
    ``share`` times all words; no target passes ``most`` times its source's words, the excess is divided
    again by weight. The sources that reach that limit are those with the least limit per weight.
    """
    one_task = W.orderBy(F.col("source").asc_nulls_last())  # a row per source
    by_limit = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    turn = F.array(*map(F.lit, weights))
    ranked = totals.withColumn(
        "weight", F.element_at(turn, ((F.row_number().over(one_task) - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumns(
        {
            "_all": F.sum("source_size").over(W.partitionBy()),
            "_weights": F.sum("weight").over(by_limit.rowsBetween(W.currentRow, W.unboundedFollowing)),
            "_before": F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    left = F.col("_all") * share - F.col("_before") * most
    ranked = ranked.withColumn("_full", left * F.col("weight") / F.col("_weights") >= F.col("source_size") * most)
    # limits are reached in the order of limit per weight: the first source that stays below ends them
    ranked = ranked.withColumn("_open", F.max(F.when(~F.col("_full"), 1).otherwise(0)).over(by_limit.rowsBetween(W.unboundedPreceding, 0)))
    rest = ranked.withColumns(
        {
            "_left": F.sum(F.when(F.col("_open") == 0, F.col("source_size")).otherwise(0)).over(W.partitionBy()),
            "_share": F.sum(F.when(F.col("_open") == 1, F.col("weight")).otherwise(0)).over(W.partitionBy()),
        }
    )
    target = F.when(F.col("_open") == 0, F.col("source_size") * most).otherwise(
        (F.col("_all") * share - F.col("_left") * most) * F.col("weight") / F.col("_share")
    )
    return rest.select("source", "source_size", "documents", target.cast("double").alias("target"))


def apportion(parties: DataFrame, by: list[str], seats: Column, weight: Column, tie: list[Column], out: str) -> DataFrame:
    """Give ``seats`` (the same within a group ``by``) to the rows of each group by highest quotients weight / (2k + 1).

    With total weight T, n rows and H seats, every row is sure of round(weight (H - n/2) / T) seats, and none
    gets more than round(weight (H + n/2) / T); the quotients between, at most 2n, are ranked. Equal quotients
    go by ``tie``.
    """
    group, order = W.partitionBy(*by), [F.col("_quotient").desc(), *tie]
    p = parties.withColumns({"_w": weight.cast("double"), "_h": seats.cast("double")})
    p = p.withColumns({"_t": F.sum("_w").over(group), "_n": F.count(F.lit(1)).over(group)})
    ratio = F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(0.0)
    p = p.withColumns(
        {
            "_low": F.floor(F.greatest(F.lit(0.0), ratio * (F.col("_h") - F.col("_n") / 2) * (1 - 1e-13) + 0.5 - 1e-9)).cast("long"),
            "_high": F.floor(ratio * (F.col("_h") + F.col("_n") / 2) * (1 + 1e-13) + 0.5 + 1e-9).cast("long"),
        }
    )
    p = p.withColumn("_open", F.col("_h") - F.sum("_low").over(group))
    # a row of k = -1 keeps the parties that have no quotient to rank
    k = F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)).otherwise(F.array().cast("array<long>"))))
    q = p.withColumn("_k", k).withColumn("_quotient", F.when(F.col("_k") >= 0, F.col("_w") / (2 * F.col("_k") + 1)))
    q = q.withColumn("_rank", F.row_number().over(group.orderBy(F.col("_k") < 0, *order)))
    won = F.sum(F.when((F.col("_k") >= 0) & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    kept = [c for c in parties.columns]
    return q.groupBy(*kept).agg((F.max("_low") + won).alias(out))


def mix(
    docs: DataFrame,
    carry: list[str],
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    shard_documents: int = SHARD_DOCUMENTS,
    seed: str = SEED,
) -> DataFrame:
    """Each document's part in the mix: ``carry`` columns and size, source_size, target, passes, start, stop, taken.

    ``docs`` has doc_id, text, source. The mix takes the document ``passes`` times whole, and once more the
    words in [start, stop) and, where the run wraps round inside the document, in [0, wrap). ``carry`` columns
    travel with the row.
    """
    docs = docs.select(*dict.fromkeys([*carry, "doc_id", "source"]), words_in(F.col("text")).alias("size"))
    if {*carry} <= {"doc_id", "source"}:  # a few bytes a row: the texts are read once and not again for each step
        docs = materialise(docs)
    sources = source_targets(docs, weights, share, most)
    seats = F.floor(F.sum("target").over(W.partitionBy()) / block_words + 0.5)
    quotas = apportion(sources.withColumn("seats", seats), [], F.col("seats"), F.col("target"), [F.col("source").asc_nulls_last()], "blocks")
    quotas = quotas.withColumn("shards", F.ceil(F.col("documents") / shard_documents)).select(
        F.col("source").alias("_source"), "source_size", "target", "blocks", "shards"
    )
    # a row per source: sent to every executor where it is small, else a join that splits skewed sources
    placed = docs.join(small_side(quotas), F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "shard", seeded(seed + "-shard", F.col("doc_id").cast("string")) % F.col("shards")
    )
    shards = placed.groupBy("_source", "blocks", "shard").agg(F.sum("size").alias("shard_size"))
    dealt = apportion(shards, ["_source"], F.col("blocks"), F.col("shard_size"), [F.col("shard")], "quota").select(
        F.col("_source").alias("_of"), F.col("shard").alias("_shard"), "shard_size", "quota"
    )
    placed = placed.join(small_side(dealt), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("shard") == F.col("_shard")))
    line = W.partitionBy("_source", "shard").orderBy(seeded(seed, F.col("doc_id").cast("string")), "doc_id", "size")
    begin = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    words = F.least(F.col("quota") * block_words, (F.col("shard_size") * most).cast("long"))
    placed = placed.withColumns({"_begin": begin, "_words": words, "_end": begin + F.col("size")})
    n = F.greatest(F.col("shard_size"), F.lit(1))
    blocks = F.ceil(n / block_words)
    first = (seeded(seed + "-start", F.coalesce("_source", F.lit("")), F.col("shard").cast("string")) % blocks) * block_words
    placed = placed.withColumns({"passes": F.floor(F.col("_words") / n), "_from": first, "_to": first + F.col("_words") % n, "_n": n})
    zero = F.lit(0).cast("long")
    inside = lambda x: F.least(F.greatest(x - F.col("_begin"), zero), F.col("size"))
    parts = placed.withColumns({"start": inside(F.col("_from")), "stop": inside(F.least("_to", "_n")), "wrap": inside(F.greatest(F.col("_to") - F.col("_n"), zero))})
    taken = F.col("passes") * F.col("size") + F.col("stop") - F.col("start") + F.col("wrap")
    return parts.select(*carry, "size", "source_size", "target", "passes", "start", "stop", "wrap", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: a row for each pass over a document, and one for each part of it that is taken.

    A whole pass keeps the text as it is; a part keeps the white space between its words. n_chars follows
    the text. Columns and their order are those of ``docs``.
    """
    columns = docs.columns
    row = F.struct(*columns).alias("_row")  # so that no column clashes with those of the mix
    mixed = mix(docs.select(row, "doc_id", "source", "text"), ["_row"], **parameters)
    entry = lambda lo, hi: F.struct(lo.alias("lo"), F.col(hi).alias("hi"))
    zero = F.lit(0).cast("long")
    full = F.array_repeat(entry(zero, "size"), F.col("passes").cast("int"))
    parts = F.filter(F.array(entry(F.col("start"), "stop"), entry(zero, "wrap")), lambda e: e["hi"] > e["lo"])
    rows = mixed.where("taken > 0").withColumn("_part", F.explode(F.concat(full, parts)))
    text = F.col("_row.text")
    units = F.regexp_extract_all(text, F.lit(WORD + SPACE + "*"), F.lit(0))
    cut = F.array_join(F.slice(units, (F.col("_part.lo") + 1).cast("int"), (F.col("_part.hi") - F.col("_part.lo")).cast("int")), "")
    is_whole = (F.col("_part.lo") == 0) & (F.col("_part.hi") == F.col("size"))
    rows = rows.withColumn("_text", F.when(is_whole, text).otherwise(cut))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns])
