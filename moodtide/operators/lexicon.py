"""Lexicon tables and lexicon scoring.

A text is split into one row per word, the words meet the lexicon in a broadcast join, everything
but the hits is dropped, and the hits of a post are added up. Words never cross the network: the
neighbours a rule needs are attached to a word before the split, so the only shuffle moves one
narrow partial sum per post. Only a lexicon above ``WORD_ROWS`` terms is met by shuffles: then each word goes
to its term and back to its text, once for all rules and without the columns of its post.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moodtide.functions import scores, valence
from moodtide.functions.text import bare_text, capital_tokens, longest_match_pattern, tokens
from moodtide.session import small_side as small_table

POST_KEYS = ("source", "id")
#: Terms of a lexicon that is sent to every executor; one takes about 140 bytes there.
WORD_ROWS = 1_000_000
#: Rows of an emoji table at most; it becomes a part of the query.
EMOJI_ROWS = 10_000

small_side = partial(small_table, max_rows=WORD_ROWS)


def merge_lexicon(base: DataFrame, domain: DataFrame) -> DataFrame:
    """All terms of both lexicons; the domain polarity wins."""
    return base.alias("b").join(domain.alias("d"), "term", "full").select(
        "term", F.coalesce("d.polarity", "b.polarity").alias("polarity")
    )


def lexicon_lookup(df: DataFrame, lexicon: DataFrame, keys: Sequence[str] = POST_KEYS, text: str = "text") -> DataFrame:
    """One row ``(keys, pos, term, polarity)`` per word of the text that the lexicon holds."""
    words = df.select(*keys, F.posexplode(_terms(text)).alias("pos", "term"))
    return words.join(small_side(lexicon), "term").select(*keys, "pos", "term", "polarity")


def _terms(text: str) -> Column:
    """The bare words of a text in small letters."""
    return tokens(F.lower(bare_text(F.col(text))))


def _identified(df: DataFrame, keys: Sequence[str], carry: Sequence[str] | None, text: str) -> tuple[DataFrame, list[str]]:
    """``df`` with a number for each of its rows, and the columns that words are grouped by.

    Rows without an id or with the same one stay apart. Where the scores are joined back, a digest of the text
    stands for the row.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    if carry is not None:
        return numbered, [*keys, *carry, "_row"]
    return numbered.withColumn("_digest", F.xxhash64(text)), [*keys, "_digest", "_row"]


def _scored(df: DataFrame, hits: DataFrame, by: Sequence[str], joined: bool, out: str) -> DataFrame:
    """Add up ``_value`` of the hits per post and squash the total."""
    total = F.coalesce(F.sum("_value"), F.lit(0.0))
    if "_emphasis" in hits.columns:
        total = valence.with_emphasis(total, F.max("_emphasis"))
    sums = hits.groupBy(*by).agg(scores.compound(total).alias(out))
    if not joined:
        return sums.drop("_row")
    same = [c for c in by if c != "_row"]
    once = sums.dropDuplicates(same).select(out, *[F.col(c).alias(f"_of_{c}") for c in same])  # equal texts have equal scores
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in same])
    return df.join(once, match, "left").select(*[c for c in df.columns if c not in ("_row", "_digest")], F.coalesce(out, F.lit(0.0)).alias(out))


def lexicon_compound(
    df: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str] = POST_KEYS,
    carry: Sequence[str] | None = None,
    text: str = "text",
    out: str = "sia_vader",
) -> DataFrame:
    """Compound score from the plain polarity total; 0 for a text without a hit.

    With ``carry`` the result holds only the keys, those columns and the score, and comes from a
    single aggregation. Without it the score is joined to all columns of ``df``. Every row keeps a score of
    its own, whether its key is unique, repeated or null.
    """
    joined = carry is None
    df, by = _identified(df, keys, carry, text)
    words = df.select(*by, F.posexplode_outer(_terms(text)).alias("_pos", "term"))
    known = words.join(small_side(lexicon), "term", "left")
    # The first word stays even when unknown, so that every post keeps a row.
    hits = known.where(F.col("polarity").isNotNull() | (F.coalesce("_pos", F.lit(0)) == 0))
    return _scored(df, hits.withColumn("_value", F.col("polarity")), by, joined, out)


def _words_in_context(df: DataFrame, by: Sequence[str], text: Column, ahead: int, words: DataFrame, large: bool, **extra: Column) -> DataFrame:
    """One row per bare word with the three words before it and ``ahead`` words after it.

    ``_w`` is the word, ``_b1`` to ``_b3`` the words before, ``_a1`` and so on those after; null
    where the text ends. A text without words gives one row of nulls. ``extra`` columns are made
    once per text, from the text ``_text``, its bare form ``_bare`` or its words ``_tokens``. Where the table ``words`` is
    ``large``, the rows come with its facts.
    """
    missing = F.lit(None).cast("string")
    found = F.col("_tokens")
    shifted = {"_w": found}
    shifted |= {f"_b{d}": F.concat(F.array(*[missing] * d), found) for d in (1, 2, 3)}
    shifted |= {f"_a{d}": F.slice(found, d + 1, F.size(found)) for d in range(1, ahead + 1)}

    bare = df.select(*by, text.alias("_text"), bare_text(text).alias("_bare"))
    split = bare.select(*by, "_text", "_bare", tokens(F.col("_bare")).alias("_tokens"))
    once = split.select(*by, "_tokens", *[c.alias(name) for name, c in extra.items()])
    if large:
        return _met_in_context(once, [*by, *extra], ahead, words)
    beside = once.select(*by, *extra, *[c.alias(name) for name, c in shifted.items()])
    rows = beside.select(*by, *extra, F.posexplode_outer(F.arrays_zip(*shifted)).alias("_pos", "_c")).select(*by, *extra, "_pos", "_c.*")
    # The shifted columns are longer than the text; its first row stays for a text without words.
    return rows.where(F.col("_w").isNotNull() | (F.coalesce("_pos", F.lit(0)) == 0))


def _met_in_context(once: DataFrame, columns: Sequence[str], ahead: int, words: DataFrame) -> DataFrame:
    """The rows of ``_words_in_context`` with the facts that ``_looked_up`` would add, from one shuffled join.

    A row goes to its word and back to its text, where windows give it the words around it and their facts; only the
    first row of a text carries the ``columns`` of the text.
    """
    facts = words.columns[1:]
    post = F.struct(*[c for c in columns if c != "_row"]).alias("_post")
    split = once.select("_row", post, F.posexplode_outer("_tokens").alias("_pos", "_w"))
    narrow = split.withColumn("_post", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_post")))
    met = narrow.join(words.withColumnRenamed("word", "_word"), F.lower("_w") == F.col("_word"), "left").drop("_word")
    order = W.partitionBy("_row").orderBy("_pos")
    around = {f"_b{d}": partial(F.lag, offset=d) for d in (1, 2, 3)} | {f"_a{d}": partial(F.lead, offset=d) for d in range(1, ahead + 1)}
    beside = {"_post": F.first("_post").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))}
    beside |= {name: at("_w").over(order) for name, at in around.items()}
    beside |= {f"{name}_{c}": at(c).over(order) for name, at in around.items() for c in facts}
    rows = met.withColumns(beside).withColumnsRenamed({c: f"term_{c}" for c in facts})
    return rows.select("_row", "_post.*", *[c for c in rows.columns if c not in ("_row", "_post")])


def translate_emoji(df: DataFrame, emoji: DataFrame, text: str = "text", out: str | None = None) -> DataFrame:
    """Replace each emoji of ``text`` by its description, with a space before it unless it begins the text or follows one.

    ``emoji`` is a table ``(emoji, description)`` of ``EMOJI_ROWS`` rows at most. A sequence of several code points is taken
    whole where the table has it, as one with a skin tone or a joiner, and otherwise by the longest key that stands at its
    place. The result goes to ``out``, or to ``text`` itself; its outer spaces go where an emoji was replaced.
    """
    names = {r["emoji"]: r["description"] for r in emoji.select("emoji", "description").limit(EMOJI_ROWS + 1).collect()}
    if len(names) > EMOJI_ROWS:
        raise ValueError(f"the emoji table has more than {EMOJI_ROWS} rows")
    out = out or text
    if not names:
        return df.withColumn(out, F.col(text))
    pattern = longest_match_pattern(list(names))
    described = F.from_json(F.lit(json.dumps(names)), "map<string, string>")
    cut = df.withColumns({"_gaps": F.split(F.col(text), pattern, -1), "_marks": F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), 1)})

    def told(mark: Column, at: Column) -> Column:
        gap = F.col("_gaps")[at]
        beside = F.when(gap == "", at == 0).otherwise(gap.endswith(" "))
        return F.concat(F.when(beside, "").otherwise(" "), F.element_at(described, mark), F.col("_gaps")[at + 1])

    whole = F.trim(F.concat(F.col("_gaps")[0], F.array_join(F.transform("_marks", told), "")))
    return cut.withColumn(out, F.when(F.size("_marks") > 0, whole).otherwise(F.col(text))).drop("_gaps", "_marks")


def _word_table(lexicon: DataFrame) -> tuple[DataFrame, bool]:
    """Every lexicon term and modifier with its polarity, degree and negation, null or 0 where it has none; and whether it is large."""
    modifiers = valence.modifier_words(lexicon.sparkSession)
    words = lexicon.select(F.col("term").alias("word"), "polarity").unionByName(modifiers, allowMissingColumns=True)
    table = words.groupBy("word").agg(
        F.max("polarity").alias("polarity"),
        F.coalesce(F.max("degree"), F.lit(0.0)).alias("degree"),
        F.coalesce(F.max("negates"), F.lit(False)).alias("negates"),
    )
    small = small_side(table)
    return small, small is table


def _looked_up(rows: DataFrame, words: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_polarity``, ``_degree`` and ``_negates`` of the word in ``column``.

    Every column is joined on its own, against the same broadcast relation, unless the rows have its facts already.
    """
    if f"{column}_{words.columns[1]}" in rows.columns:
        return rows
    facts = words.select(F.col("word").alias("_word"), *[F.col(c).alias(f"{column}_{c}") for c in words.columns[1:]])
    return rows.join(facts, F.col(column) == F.col("_word"), "left").drop("_word")


def _hits(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The lexicon hits, and the first word of every text so that each post keeps a row."""
    known = _looked_up(rows, words, "term")
    return known.where(F.col("term_polarity").isNotNull() | (F.coalesce("_pos", F.lit(0)) == 0))


def _modifies(distance: int) -> Column:
    """Whether the word at this distance before a hit exists and is no lexicon term itself."""
    return F.col(f"_b{distance}").isNotNull() & F.col(f"_b{distance}_polarity").isNull()


def _if_modifies(distance: int, value: Column, neutral: float) -> Column:
    return F.when(_modifies(distance), F.coalesce(value, F.lit(neutral))).otherwise(neutral)


def lexicon_compound_modifiers(
    df: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str] = POST_KEYS,
    carry: Sequence[str] | None = None,
    text: str = "text",
    out: str = "sia_vader",
) -> DataFrame:
    """Compound score with degree words and negators up to three places before a hit.

    A word that is itself a lexicon term does not modify the words after it.
    """
    joined = carry is None
    df, by = _identified(df, keys, carry, text)
    words, large = _word_table(lexicon)
    rows = _words_in_context(df, by, F.lower(text), 0, words, large).withColumn("term", F.col("_w"))
    hits = _hits(rows, words)
    for d in (1, 2, 3):
        hits = _looked_up(hits, words, f"_b{d}")
    factors = {d: valence.negation_factor(F.col(f"_b{d}"), F.coalesce(f"_b{d}_negates", F.lit(False))) for d in (1, 2, 3)}
    hits = hits.withColumns(
        {f"_degree{d}": _if_modifies(d, F.col(f"_b{d}_degree"), 0.0) for d in factors}
        | {f"_factor{d}": _if_modifies(d, factors[d], 1.0) for d in factors}
    )
    value = F.col("term_polarity")
    for d in (1, 2, 3):
        hits = hits.withColumn("_value", valence.shifted(value, F.col(f"_degree{d}"), F.lit(0.0), d) * F.col(f"_factor{d}"))
        value = F.col("_value")
    return _scored(df, hits, by, joined, out)


def lexicon_compound_emphasis(
    df: DataFrame,
    lexicon: DataFrame,
    keys: Sequence[str] = POST_KEYS,
    carry: Sequence[str] | None = None,
    text: str = "text",
    out: str = "sia_vader",
    emoji: DataFrame | None = None,
) -> DataFrame:
    """Compound score with all published rules.

    On top of the modifiers: words in capitals, exclamation and question marks, the turn at the
    first "but", "no", "least", "never so", idioms and weakening phrases. With ``emoji``, a table of descriptions, emoji
    are scored as their descriptions; the text itself stays.
    """
    joined = carry is None
    df, by = _identified(df, keys, carry, text)
    if emoji is not None:
        df = translate_emoji(df, emoji, text, "_told")
        text = "_told"
    capitals = capital_tokens(F.col("_bare"))
    words, large = _word_table(lexicon)
    rows = _words_in_context(
        df,
        by,
        F.col(text),
        2,
        words,
        large,
        _mixed=(capitals > 0) & (capitals < F.size("_tokens")),
        _but=F.array_position(F.transform("_tokens", F.lower), "but"),
        _emphasis=valence.punctuation_emphasis(F.col("_text")),
    ).withColumn("term", F.lower("_w"))
    lower = {f"_b{d}": F.lower(f"_b{d}") for d in (1, 2, 3)} | {f"_a{d}": F.lower(f"_a{d}") for d in (1, 2)}
    shouted = {f"_caps{d}": valence.capitals(F.col(f"_b{d}"), F.col("_mixed")) for d in (1, 2, 3)}
    hits = _hits(rows, words).withColumns(lower | shouted | {"_caps": valence.capitals(F.col("_w"), F.col("_mixed"))})
    for c in ("_b1", "_b2", "_b3", "_a1"):
        hits = _looked_up(hits, words, c)
    for phrases in (valence.PAIRS, valence.TRIPLES):
        hits = hits.withColumns({name: valence.joined(*parts) for name, parts in phrases.items()})

    term, polarity = F.col("term"), F.col("term_polarity")
    before = {d: F.col(f"_b{d}") for d in (1, 2, 3)}
    after = {d: F.col(f"_a{d}") for d in (1, 2)}
    no = F.lit("no")
    follows_no = (
        before[1].eqNullSafe(no)
        | before[2].eqNullSafe(no)
        | (before[3].eqNullSafe(no) & F.coalesce(before[1].isin("or", "nor"), F.lit(False)))
    )
    stated = (
        F.when(follows_no, polarity * valence.NEGATION_FACTOR)
        .when((term == "no") & F.col("_a1_polarity").isNotNull(), F.lit(0.0))
        .otherwise(polarity)
    )
    modifiers = {}
    for d in (1, 2, 3):
        degree, listed = F.col(f"_b{d}_degree"), F.coalesce(f"_b{d}_negates", F.lit(False))
        modifiers[f"_degree{d}"] = _if_modifies(d, degree, 0.0)
        modifiers[f"_loud{d}"] = _if_modifies(d, F.when(degree != 0, F.col(f"_caps{d}")), 0.0)
        modifiers[f"_factor{d}"] = _if_modifies(d, valence.contextual_negation_factor(before, listed, d), 1.0)
    least = before[1].eqNullSafe(F.lit("least")) & ~F.coalesce(before[2].isin("at", "very"), F.lit(False))
    silent = (F.col("term_degree") != 0) | ((term == "kind") & after[1].eqNullSafe(F.lit("of")))
    place, turn = F.col("_pos") + 1, F.col("_but")
    hits = hits.withColumns(
        {
            **modifiers,
            "_stated": stated,
            "_idiom": F.when(_modifies(3), valence.idiom_value()),
            "_weakening": F.when(_modifies(3), valence.weakening()).otherwise(0.0),
            "_least": F.when(least & _modifies(1), valence.NEGATION_FACTOR).otherwise(1.0),
            "_turn": F.when(silent, 0.0)
            .when((turn > 0) & (place < turn), valence.BEFORE_BUT)
            .when((turn > 0) & (place > turn), valence.AFTER_BUT)
            .otherwise(1.0),
        }
    )
    louder = F.when(F.col("_stated") > 0, F.col("_caps")).otherwise(-F.col("_caps"))
    hits = hits.withColumn("_value", F.col("_stated") + louder)
    for d in (1, 2, 3):
        moved = valence.shifted(F.col("_value"), F.col(f"_degree{d}"), F.col(f"_loud{d}"), d)
        hits = hits.withColumn("_value", moved * F.col(f"_factor{d}"))
    settled = F.coalesce("_idiom", "_value") - F.col("_weakening")
    hits = hits.withColumn("_value", settled * F.col("_least") * F.col("_turn"))
    return _scored(df, hits, by, joined, out).drop("_told")
