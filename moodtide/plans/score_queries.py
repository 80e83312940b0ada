"""Queries: scoring, aggregates over scores, vocabulary and word statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions import models, scores, valence
from moodtide.functions.text import COUNTED_WORD, VOCABULARY_TOKEN
from moodtide.operators import clean, daily, encode, learn, lexicon, stats
from moodtide.plans import fixtures as fx
from moodtide.plans.post_queries import PLAIN_SCORED_CTE, WEIGHT, compound_cte
from moodtide.plans.registry import query
from moodtide.plans.rules_sql import CONTEXT_CTE, FIRST_TOKENS, TOTALS_CTE, quoted
from moodtide.session import materialise, scratch_path
from moodtide.sources import readers


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.build_text(fx.posts(spark, sf), limit=None).select("source", "id", "text")


TEXTS_CTE = f"{fx.POSTS_CTE}, {fx.LEXICON_CTE}, texts as (select source, id, title || ' ' || selftext as text from posts)"


@query(
    "lexicon_compound",
    f"with {TEXTS_CTE}, {compound_cte('texts', 'text')} select source, id, round(sia_vader, 6) + 0.0 as sia_vader from compound",
)
def lexicon_compound(spark: SparkSession, sf: str) -> DataFrame:
    found = lexicon.lexicon_compound(_texts(spark, sf), fx.lexicon(spark), carry=[])
    return found.withColumn("sia_vader", F.round("sia_vader", 6) + F.lit(0.0))


# The texts hold few of the words the rules are about, so common ones are replaced by them.
REWORDED = (
    (" in ", " not "), (" is ", " VERY "), (" he ", " but "), (" by ", " so "), (" at ", " never "),
    (" this ", " least "), (" from ", " kind of "), (" of ", " OF "), (" be ", " barely "), ("s. ", "s! "), ("t. ", "t? "),
)
#: Terms that are also modifiers, so that both roles occur.
RULED_LEXICON = fx.LEXICON | {"no": -0.3, "are": 0.6, "never": -0.2}


def _reworded(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    for old, new in REWORDED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return clean.build_text(fx.posts(spark, sf), limit=None).select("source", "id", text.alias("text"))


def _ruled_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULED_LEXICON.items()), "term string, polarity double")


def _nested_replace() -> str:
    sql = "title || ' ' || selftext"
    for old, new in REWORDED:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


RULES_CTE = f"""{fx.POSTS_CTE},
    lexicon(term, polarity) as (values {", ".join(f"('{t}', {p}::double)" for t, p in RULED_LEXICON.items())}),
    texts as (select source, id, {_nested_replace()} as text from posts),
    {CONTEXT_CTE}"""


def _plain_step(value: str, d: int) -> str:
    moved = f"({value} + case when {value} < 0 then -deg{d} else deg{d} end * {valence.DISTANCE_DAMPING[d]})"
    return f"case when not known{d} then {moved} * case when neg{d} then {valence.NEGATION_FACTOR} else 1 end else {value} end"


@query(
    "lexicon_compound_modifiers",
    f"""with {RULES_CTE},
    v1 as (select source, id, pos, {_plain_step("polarity", 1)} as v, deg2, neg2, known2, deg3, neg3, known3 from context where known),
    v2 as (select source, id, pos, {_plain_step("v", 2)} as v, deg3, neg3, known3 from v1),
    v3 as (select source, id, {_plain_step("v", 3)} as v from v2),
    sums as (select source, id, sum(v) as s from v3 group by source, id)
    select source, id, round(coalesce(s / sqrt(s * s + 15), 0.0), 6) + 0.0 as sia_vader from texts left join sums using (source, id)""",
)
def lexicon_compound_modifiers(spark: SparkSession, sf: str) -> DataFrame:
    found = lexicon.lexicon_compound_modifiers(_reworded(spark, sf), _ruled_lexicon(spark), carry=[])
    return found.withColumn("sia_vader", F.round("sia_vader", 6) + F.lit(0.0))


@query(
    "lexicon_compound_emphasis",
    f"""with {RULES_CTE},
    {TOTALS_CTE}
    select source, id, round(s / sqrt(s * s + 15), 6) + 0.0 as sia_vader from totals""",
)
def lexicon_compound_emphasis(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over the whole texts."""
    found = lexicon.lexicon_compound_emphasis(_reworded(spark, sf), _ruled_lexicon(spark), carry=[])
    return found.withColumn("sia_vader", F.round("sia_vader", 6) + F.lit(0.0))


#: Emoji found one after another: the longest key that stands at the first place where any stands.
TOLD_CTE = f"""{fx.EMOJI_TEXTS_CTE},
    walk as (
      select source, id, text as rest, '' as told, true as beside from emoji_texts
      union all
      select source, id,
             case when k is null then '' else substring(rest, (spot + length(k))::int) end,
             case when k is null then told || rest
                  else told || left(rest, (spot - 1)::int) || case when spot = 1 and beside or spot > 1 and rest[spot - 1] = ' ' then '' else ' ' end || description end,
             false
      from (select *, f.k as k, f.d as description, f.p as spot from (
        select w.*, (select arg_min(struct_pack(k := emoji, d := description, p := instr(rest, emoji)), (instr(rest, emoji), -length(emoji)))
                     from emoji where instr(rest, emoji) > 0) as f from walk w where rest <> '') found) s),
    told_texts as (
      select e.source, e.id, case when e.text = told then told else trim(told) end as text
      from walk w join emoji_texts e using (source, id) where rest = '')"""


@query("translate_emoji", f"with recursive {TOLD_CTE} select source, id, text from told_texts")
def translate_emoji(spark: SparkSession, sf: str) -> DataFrame:
    """Planted emoji, some with tones and joiners, as their descriptions."""
    path = scratch_path(spark, "emoji")
    fx.emoji(spark).write.options(header=True, sep="\t", quote="").csv(path)
    return lexicon.translate_emoji(fx.emoji_texts(spark, sf), readers.load_emoji(spark, path))


@query(
    "lexicon_compound_emoji",
    f"""with recursive {TOLD_CTE}, {fx.LEXICON_CTE}, texts as (select source, id, text from told_texts), {CONTEXT_CTE}, {TOTALS_CTE}
    select source, id, round(s / sqrt(s * s + 15), 6) + 0.0 as sia_vader from totals""",
)
def lexicon_compound_emoji(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over texts with planted emoji."""
    scored = lexicon.lexicon_compound_emphasis(fx.emoji_texts(spark, sf), fx.lexicon(spark), carry=[], emoji=fx.emoji(spark))
    return scored.select("source", "id", (F.round("sia_vader", 6) + F.lit(0.0)).alias("sia_vader"))


@query(
    "model_probability",
    f"""with {fx.LEXICON_CTE}, words as (
      select doc_id, unnest({FIRST_TOKENS}) as term from documents),
    logits as (select doc_id, sum(polarity) as z from words join lexicon using (term) group by doc_id)
    select doc_id as id, round(1 / (1 + exp(-coalesce(z, 0.0))), 6) as probability from documents left join logits using (doc_id)""",
)
def model_probability(spark: SparkSession, sf: str) -> DataFrame:
    documents = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    scored = learn.score_with_model(documents, models.bag_of_words_logit(fx.LEXICON))
    return scored.select("id", F.round("probability", 6).alias("probability"))


# --- score arithmetic ---------------------------------------------------------------------------


@query("rescale_unit", f"with {fx.POSTS_CTE} select id, round(2 * cast(upvote_ratio as double) - 1, 6) + 0.0 as y from posts")
def rescale_unit(spark: SparkSession, sf: str) -> DataFrame:
    y = F.round(scores.rescale_unit(F.col("upvote_ratio").cast("double")), 6) + F.lit(0.0)
    return fx.posts(spark, sf).select("id", y.alias("y"))


@query("sigmoid", "select event_id, round(1 / (1 + exp(-((value - 25) / 5))), 6) as y from events")
def sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    y = scores.sigmoid((F.col("value") - 25) / 5)
    return fx.table(spark, sf, "events").select("event_id", F.round(y, 6).alias("y"))


@query(
    "ensemble_mean",
    f"""with {fx.POSTS_CTE}, {fx.LEXICON_CTE}, {compound_cte("posts", "title", "titles")}, {compound_cte("posts", "selftext", "bodies")}
    select a.source, a.id, round((a.sia_vader + b.sia_vader) / 2, 6) + 0.0 as score
    from titles a join bodies b on a.source = b.source and a.id = b.id""",
)
def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the lexicon scores of title and body."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("title", "selftext")]
    texts = fx.posts(spark, sf).select("source", "id", F.inline(F.array(*fields)))
    found = lexicon.lexicon_compound(texts, fx.lexicon(spark), keys=("source", "id", "field"), carry=[])
    both = found.groupBy("source", "id").agg(*[F.max(F.when(F.col("field") == c, F.col("sia_vader"))).alias(c) for c in ("title", "selftext")])
    score = scores.ensemble_mean([F.col("title"), F.col("selftext")])
    return both.select("source", "id", (F.round(score, 6) + F.lit(0.0)).alias("score"))


SENTIMENT = "((id % 21) - 10) / 10.0"


def _sentiment() -> Column:
    return (F.col("id") % 21 - 10) / 10.0


@query("engagement_weight", f"with {fx.POSTS_CTE} select id, round({WEIGHT} * {SENTIMENT}, 6) + 0.0 as weighted from posts")
def engagement_weight(spark: SparkSession, sf: str) -> DataFrame:
    weighted = scores.engagement_weight(_sentiment(), F.col("score"), F.col("num_comments"), F.col("upvote_ratio"))
    return fx.posts(spark, sf).select("id", (F.round(weighted, 6) + F.lit(0.0)).alias("weighted"))


@query(
    "blend_sentiment",
    f"""with {PLAIN_SCORED_CTE}
    select source, id, round(0.3 * {WEIGHT} * {SENTIMENT} + 0.7 * {WEIGHT} * sia_vader, 6) + 0.0 as sia
    from scored""",
)
def blend_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    posts = clean.build_text(clean.drop_marked(fx.posts(spark, sf), fx.MARKERS))
    carry = ["score", "num_comments", "upvote_ratio"]
    scored = lexicon.lexicon_compound(posts, fx.lexicon(spark), carry=carry).withColumn("sia_bert", _sentiment())
    return daily.add_blend(scored, 0.3).select("source", "id", (F.round("sia", 6) + F.lit(0.0)).alias("sia"))


PROBABILITY = "(doc_id * 37 % 1001) / 1000.0::double"


def _probability() -> Column:
    return (F.col("doc_id") * 37 % 1001) / F.lit(1000.0)


@query(
    "classify_label",
    f"""select doc_id, case when {PROBABILITY} > 0.5 then 'Positive' else 'Negative' end as sentiment,
    cast(trunc(case when {PROBABILITY} > 0.5 then {PROBABILITY} * 100 else 100 - {PROBABILITY} * 100 end) as int) as percentage
    from documents""",
)
def classify_label(spark: SparkSession, sf: str) -> DataFrame:
    documents = fx.table(spark, sf, "documents").select("doc_id", _probability().alias("probability"))
    return learn.classify_label(documents).select("doc_id", "sentiment", "percentage")


@query("accuracy_flag", f"select doc_id, cast({PROBABILITY} > 0.5 as int) = quality as correct from labels")
def accuracy_flag(spark: SparkSession, sf: str) -> DataFrame:
    flag = scores.accuracy_flag(_probability(), F.col("quality"))
    return fx.table(spark, sf, "labels").select("doc_id", flag.alias("correct"))


# --- vocabulary and words -----------------------------------------------------------------------

VOCAB_CTE = f"""tokens as (select doc_id, regexp_extract_all(lower(text), '{VOCABULARY_TOKEN}') as ts from documents),
    vocab as (
      select term, cast(row_number() over (order by n desc, term) + 3 as int) as token_id, n
      from (select term, count(*) as n from (select unnest(ts) as term from tokens) group by term))"""


@query("build_vocab", f"with {VOCAB_CTE} select term, token_id, n from vocab")
def build_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return encode.build_vocab(fx.documents(spark, sf))


@query(
    "encode_sequence",
    f"""with {VOCAB_CTE}, used as (
      select doc_id, generate_subscripts(ts, 1) as pos, unnest(ts) as term from (select doc_id, ts[1:48] as ts from tokens)),
    ids as (
      select doc_id, list(coalesce(token_id, 1) order by pos) as body from used left join vocab using (term) group by doc_id),
    padded as (
      select doc_id, list_resize(list_concat([2], coalesce(body, []), [3]), 50, 0) as input_ids
      from documents left join ids using (doc_id))
    select doc_id as id, array_to_string(input_ids, ' ') as input_ids,
           array_to_string([cast(i <> 0 as int) for i in input_ids], ' ') as attention_mask from padded""",
)
def encode_sequence(spark: SparkSession, sf: str) -> DataFrame:
    documents = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    vocab = materialise(encode.build_vocab(documents))
    encoded = encode.encode_sequence(documents, vocab, 50)
    return encoded.select("id", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "attention_mask")])


PIECES_CTE = f"""{VOCAB_CTE},
    small as (select term, token_id from vocab where token_id < 2004),
    characters as (select distinct unnest(string_split(term, '')) as c from small),
    added as (
      select term, cast(2003 + row_number() over (order by term) as int) as token_id
      from (select c as term from characters union select '##' || c from characters) where term not in (select term from small)),
    pieces as (select * from small union all select * from added),
    words as (select distinct unnest(ts[1:48]) as word from tokens),
    walk as (
      select word, 1 as spot, []::int[] as ids from words
      union all
      select word, spot + coalesce(length(p.t), length(word)), case when p.i is null then [1] else list_append(ids, p.i) end
      from (
        select w.word, w.spot, w.ids,
               (select arg_max(struct_pack(t := substring(w.word, w.spot::int, n::int), i := token_id), n)
                from pieces, range(1, 65) r(n)
                where n <= length(w.word) - w.spot + 1 and pieces.term = case when w.spot > 1 then '##' else '' end || substring(w.word, w.spot::int, n::int)) as p
        from walk w where w.spot <= length(w.word)) s),
    cut as (select word, case when list_contains(ids, 1) then [1] else ids end as ids from walk where spot > length(word))"""


def _piece_sql() -> str:
    return f"""with recursive {PIECES_CTE}, used as (
      select doc_id, generate_subscripts(ts, 1) as pos, unnest(ts) as word from (select doc_id, ts[1:48] as ts from tokens)),
    ids as (select doc_id, flatten(list(ids order by pos))[1:48] as body from used join cut using (word) group by doc_id),
    padded as (
      select doc_id, list_resize(list_concat([2], coalesce(body, []), [3]), 50, 0) as input_ids
      from documents left join ids using (doc_id))
    select doc_id as id, array_to_string(input_ids, ' ') as input_ids from padded"""


@query("encode_pieces", _piece_sql())
def encode_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences over the 2,000 most frequent words and all characters of theirs; other words are cut into these."""
    documents = fx.documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    pieces = materialise(encode.with_characters(materialise(encode.build_vocab(documents, size=2000))))
    encoded = encode.encode_pieces(documents, pieces, 50)
    return encoded.select("id", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


STOPWORDS = ("the", "of", "and", "der", "die", "les", "que")
COUNTS_CTE = f"""counts as (
      select term, count(*) as n from (select unnest(regexp_extract_all(lower(text), '{COUNTED_WORD.replace("'", "''")}')) as term from documents)
      where term not in {quoted(STOPWORDS)} group by term)"""


def _stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "term string")


@query("word_frequency", f"with {COUNTS_CTE} select term, n from counts order by n desc, term limit 200")
def word_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return stats.word_frequency(fx.documents(spark, sf), 200, _stopwords(spark))


@query(
    "top_words",
    "select term, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from conversations) "
    "group by term order by n desc, term limit 25",
)
def top_words(spark: SparkSession, sf: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("term")
    counts = fx.table(spark, sf, "conversations").select(words).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_words(counts, 25)


# --- aggregates over scores ---------------------------------------------------------------------


@query(
    "daily_sentiment",
    f"""with {fx.POSTS_CTE} select source, date, round(sum({SENTIMENT}), 6) + 0.0 as sia_bert_sum, round(sum(upvote_ratio::double), 6) as sia_vader_sum,
    round(sum({WEIGHT} * {SENTIMENT}), 6) + 0.0 as sia_sum, count(nullif(title, '')) as num_posts, cast(sum(num_comments) as bigint) as num_comments
    from posts group by source, date""",
)
def daily_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    weighted = scores.engagement_weight(_sentiment(), F.col("score"), F.col("num_comments"), F.col("upvote_ratio"))
    scored = fx.posts(spark, sf).withColumns(
        {"sia_bert": _sentiment(), "sia_vader": F.col("upvote_ratio").cast("double"), "sia": weighted}
    )
    sums = ("sia_bert_sum", "sia_vader_sum", "sia_sum")
    return daily.daily_sentiment(scored).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in sums})


def _two_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = lexicon.lexicon_compound(_texts(spark, sf), fx.lexicon(spark), carry=[])
    return scored.select(F.round("sia_vader", 9).alias("sia_vader"), _sentiment().alias("sia_bert"))


LONG_CTE = f"""{TEXTS_CTE}, {compound_cte("texts", "text")},
    long as (
      select 'sia_vader' as metric, round(sia_vader, 9) as value from compound
      union all select 'sia_bert', {SENTIMENT} from posts)"""


def _bin_sql(bins: int) -> str:
    return f"cast(least(floor({bins} * (value + 1) / 2), {bins - 1}) + 1 as int)"


@query(
    "score_histogram",
    f"""with {LONG_CTE} select metric, {_bin_sql(40)} as bin, count(*) as n, round(-1 + ({_bin_sql(40)} - 1) * 0.05, 6) + 0.0 as lower,
    round(-1 + {_bin_sql(40)} * 0.05, 6) + 0.0 as upper from long group by metric, {_bin_sql(40)}""",
)
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.score_histogram(_two_scores(spark, sf), bins=40)
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("lower", "upper")})


@query(
    "auto_histogram",
    f"""with {LONG_CTE},
    facts as (
      select metric, count(*) as total, min(value) as lo, max(value) as hi,
             2 * (quantile_disc(value, 0.75) - quantile_disc(value, 0.25)) / pow(count(*), 1 / 3::double) as step from long group by metric),
    sized as (
      select *, case when hi > lo then least(greatest(case when step > 0 then ceil((hi - lo) / step) else floor(sqrt(total)) end, 1), 50) else 1 end as bins
      from facts),
    placed as (
      select metric, lo, (hi - lo) / bins as width, case when hi > lo then least(floor((value - lo) / ((hi - lo) / bins)) + 1, bins) else 1 end::int as bin
      from long join sized using (metric))
    select metric, bin, count(*) as n, round(lo + (bin - 1) * width, 6) + 0.0 as lower, round(lo + bin * width, 6) + 0.0 as upper
    from placed group by metric, bin, lo, width""",
)
def auto_histogram(spark: SparkSession, sf: str) -> DataFrame:
    found = stats.auto_histogram(_two_scores(spark, sf))
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("lower", "upper")})


@query(
    "score_density",
    f"""with {LONG_CTE},
    width as (select metric, stddev_samp(value) * pow(count(*), -0.2) as h, count(*) as total from long group by metric),
    grid as (select cast(p as int) as point, -1 + p * 0.02::double as x from range(101) t(p))
    select metric, point, round(x, 6) + 0.0 as x,
           round(sum(exp(-0.5 * pow((x - value) / h, 2)) / (total * h * sqrt(2 * pi()))), 6) as density, true as within_bound
    from long join width using (metric), grid group by metric, point, x""",
)
def score_density(spark: SparkSession, sf: str) -> DataFrame:
    """The density from the moments of bins equals the kernels of all rows to six places, as its bound promises."""
    found = stats.score_density(_two_scores(spark, sf))
    rounded = [(F.round("x", 6) + F.lit(0.0)).alias("x"), F.round("density", 6).alias("density")]
    return found.select("metric", "point", *rounded, (F.col("bound") < 1e-7).alias("within_bound"))


LOGIT = "((d.n_chars % 1000) / 250.0 - 2)"


@query(
    "batch_metrics",
    f"""with rows as (
      select (row_number() over (order by doc_id) - 1) // 32 as batch, {LOGIT} as z, quality as y
      from documents d join labels using (doc_id)),
    batches as (
      select batch, avg(case when cast(1 / (1 + exp(-z)) > 0.5 as int) = y then 1.0 else 0.0 end) as accuracy,
             avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) as loss
      from rows group by batch)
    select round(avg(accuracy), 6) as accuracy, round(sum(loss), 6) as loss, count(*) as batches from batches""",
)
def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    documents = fx.table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 250.0 - 2).alias("logit"))
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    found = stats.batch_metrics(documents.join(labels, "doc_id"), ["doc_id"])
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "loss")})


@query(
    "select_best",
    """with runs as (select event_type as model, cast(day(ts) as int) as epoch, round(avg(value), 0) as accuracy from events group by 1, 2)
    select model, epoch, accuracy from runs
    qualify row_number() over (partition by model order by accuracy desc, epoch) = 1""",
)
def select_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best day of each event type; rounding makes ties."""
    runs = (
        fx.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 0).alias("accuracy"))
    )
    return stats.select_best(runs, "accuracy", "epoch", ["model"])
