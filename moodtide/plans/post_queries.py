"""Queries: sources, sinks, cleaning, set operations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.operators import clean, daily, lexicon, series
from moodtide.plans import artefacts, flows
from moodtide.plans import fixtures as fx
from moodtide.plans.registry import query
from moodtide.plans.rules_sql import BARE, CONTEXT_CTE, TOTALS_CTE, WORDS, classifier_cte
from moodtide.plans.series_sql import INDICATED_CTE
from moodtide.session import materialise, scratch_path
from moodtide.sources import readers, writers


def _ratio() -> object:
    return F.round(F.col("upvote_ratio").cast("double"), 6).alias("upvote_ratio")


# --- sources and sinks --------------------------------------------------------------------------


@query(
    "read_posts",
    f"""with {fx.RAW_POSTS_CTE}
    select 'files' as source, id, coalesce(title, '') as title, coalesce(selftext, '') as selftext,
           coalesce(score, 1) as score, coalesce(num_comments, 0) as num_comments,
           round(cast(coalesce(upvote_ratio, 1) as double), 6) as upvote_ratio,
           cast(to_timestamp(created_utc) at time zone 'UTC' as date) as date
    from raw_posts""",
)
def read_posts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "posts")
    fx.raw_posts(spark, sf).drop("source").write.options(**writers.CSV_OPTIONS).csv(path)
    posts = readers.read_posts(spark, path, source="files", pattern="*.csv")
    typed = clean.epoch_to_date(clean.cast_defaults(clean.fill_text_nulls(posts)))
    return typed.select("source", "id", "title", "selftext", "score", "num_comments", _ratio(), "date")


@query("read_messages", f"with {fx.MESSAGES_CTE} select id, date, text from messages")
def read_messages(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "chat")
    fx.messages(spark, sf).select(F.to_json(F.struct("id", "date", "text"))).write.text(path)
    chat = readers.read_messages(spark, path, layout="lines")
    return clean.iso_to_date(clean.flatten_messages(chat)).select("id", "date", "text")


def _exported(spark: SparkSession, sf: str, path: str) -> None:
    """The messages as one exported document per conversation, indented as the exporter does."""
    one = F.concat(F.lit("  {\n"), F.substring(F.to_json(F.struct("id", "date", "text")), 2, 1 << 30))
    one = F.concat(F.substring(one, F.lit(1), F.length(one) - 1), F.lit("\n  }"))
    rows = fx.messages(spark, sf).select(F.floor(F.col("id") / 1000).alias("chat"), "id", one.alias("one"))
    bodies = rows.groupBy("chat").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "one"))), lambda m: m["one"]), ",\n").alias("b"))
    document = F.concat(F.lit('{\n "name": "chat",\n "messages": [\n'), F.col("b"), F.lit("\n ]\n}"))
    bodies.select("chat", document.alias("value")).write.partitionBy("chat").text(path)


def _layout(spark: SparkSession, sf: str, layout: str) -> DataFrame:
    path = scratch_path(spark, "exported")
    _exported(spark, sf, path)
    chat = readers.read_messages(spark, f"{path}/*", layout=layout)
    return clean.iso_to_date(clean.flatten_messages(chat)).select("id", "date", "text")


@query("read_messages_document", f"with {fx.MESSAGES_CTE} select id, date, text from messages")
def read_messages_document(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per conversation."""
    return _layout(spark, sf, "document")


@query("read_messages_indented", f"with {fx.MESSAGES_CTE} select id, date, text from messages")
def read_messages_indented(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents, cut at the exporter's indentation."""
    return _layout(spark, sf, "indented")


@query(
    "read_indicators",
    f"with {fx.INDICATORS_CTE} select date, round(closing_price, 6) as closing_price, "
    "cast(active_addr_cnt as double) as active_addr_cnt, cast(tx_cnt as double) as tx_cnt from indicators",
)
def read_indicators(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    fx.indicators(spark, sf).select(
        F.col("date").cast("string").alias("Time"),
        F.col("tx_cnt").alias("BTC / Tx Cnt"),
        F.col("closing_price").alias("BTC / Closing Price"),
        F.col("active_addr_cnt").alias("BTC / Active Addr Cnt"),
    ).write.options(header=True).csv(path)
    metrics = readers.read_indicators(spark, path)
    return metrics.withColumn("closing_price", F.round("closing_price", 6))


@query("read_prices", f"with {fx.PRICES_CTE} select * from prices")
def read_prices(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prices")
    fx.prices(spark, sf).drop("series_id").write.options(header=True).csv(path)
    return readers.read_prices(spark, path, "orders")


@query(
    "read_labelled",
    r"""select regexp_replace(d.text, '[\t\r\n]+', ' ', 'g') as sentence, l.quality as label
    from documents d join labels l using (doc_id)""",
)
def read_labelled(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "labelled")
    flat = F.regexp_replace("text", r"[\t\r\n]+", " ").alias("sentence")
    plain = {"sep": "\t", "quote": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    fx.labelled(spark, sf).select(flat, "label").write.options(header=True, **plain).csv(path)
    return readers.read_labelled(spark, path)


@query("load_lexicon", f"with {fx.LEARNED_LEXICON_CTE} select term, polarity from learned")
def load_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "lexicon")
    fx.learned_lexicon(spark, sf).write.options(header=True).csv(path)
    return readers.load_lexicon(spark, path)


@query(
    "normalise_records",
    """select cast(doc_id as varchar) as doc_id, source, cast(null as varchar) as title, cast(n_chars as int) as n_chars,
       cast(null as double) as upvote_ratio from documents""",
)
def normalise_records(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"doc_id": "string", "source": "string", "title": "string", "n_chars": "int", "upvote_ratio": "double"}
    return readers.normalise_records(fx.table(spark, sf, "documents"), columns)


def scored_posts(spark: SparkSession, sf: str, posts: DataFrame, keep_text: bool = False) -> DataFrame:
    """Posts scored as the flows do it: all rules over the merged lexicon, blended with the trained classifier."""
    terms, classifier = artefacts.merged_lexicon(spark, sf), artefacts.word_classifier(spark, sf)
    return flows.score_posts(posts, terms, flows.POST_MODEL_SHARE, classifier, markers=fx.MARKERS, keep_text=keep_text)


def _scored(spark: SparkSession, sf: str, keep_text: bool = False) -> DataFrame:
    return scored_posts(spark, sf, fx.posts(spark, sf), keep_text)


def compound_cte(rows: str, text: str, out: str = "compound") -> str:
    """CTEs giving ``(source, id, sia_vader)`` for the plain polarity total of a text column."""
    return f"""{out}_tokens as (
      select source, id, unnest({WORDS.format(text=text)}) as t from {rows}),
    {out}_sums as (
      select source, id, sum(polarity) as s
      from {out}_tokens join lexicon on term = lower({BARE.format(t="t")}) group by source, id),
    {out} as (
      select r.source, r.id, coalesce(s / sqrt(s * s + 15), 0.0) as sia_vader
      from {rows} r left join {out}_sums using (source, id))"""


WEIGHT = """(1 / (1 + exp(-((score / cast(upvote_ratio as double) + 2.316 * num_comments) / 10))))
            * (2 * cast(upvote_ratio as double) - 1)"""

CLEAN_CTE = """clean as (
  select *, left(title || ' ' || selftext, 500) as text from posts
  where not (contains(title, 'license') or contains(title, '!') or contains(selftext, 'license') or contains(selftext, '!')))"""

#: Both lexicons of the flows, the domain's terms winning.
MERGED_CTE = f"""{fx.LEARNED_LEXICON_CTE}, {fx.LEXICON_CTE.replace("lexicon(", "domain(")},
    lexicon as (
      select coalesce(d.term, b.term) as term, coalesce(d.polarity, b.polarity) as polarity
      from learned b full join domain d on b.term = d.term)"""

#: The plain total of the small lexicon.
PLAIN_SCORED_CTE = f"""{fx.POSTS_CTE}, {fx.LEXICON_CTE}, {CLEAN_CTE},
    {compound_cte("clean", "text")},
    scored as (select c.*, sia_vader from clean c join compound using (source, id))"""

#: The whole scorer of the flows: all rules over the merged lexicon, blended with the classifier.
SCORED_CTE = f"""{fx.POSTS_CTE}, {MERGED_CTE}, {CLEAN_CTE},
    texts as (select source, id, text from clean),
    {CONTEXT_CTE},
    {TOTALS_CTE},
    {classifier_cte("texts")},
    parts as (
      select c.*, 2 * p - 1 as sia_bert, s / sqrt(s * s + 15) as sia_vader, {WEIGHT} as weight
      from clean c join totals using (source, id) join classified using (source, id)),
    scored as (
      select * exclude (weight), {flows.POST_MODEL_SHARE} * weight * sia_bert + {1 - flows.POST_MODEL_SHARE} * weight * sia_vader as sia
      from parts)"""

DAILY_CTE = f"""{SCORED_CTE},
    daily as (
      select source, date, sum(sia_bert) as sia_bert_sum, sum(sia_vader) as sia_vader_sum, sum(sia) as sia_sum,
             count(nullif(title, '')) as num_posts, cast(sum(num_comments) as bigint) as num_comments
      from scored group by source, date)"""

DAILY_COLUMNS = """source, date, round(sia_bert_sum, 6) + 0.0 as sia_bert_sum, round(sia_vader_sum, 6) + 0.0 as sia_vader_sum,
    round(sia_sum, 6) + 0.0 as sia_sum, num_posts, num_comments"""


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


@query(
    "write_scored",
    f"""with {SCORED_CTE}
    select source, id, title, selftext, text, date, score, num_comments, round(sia_bert, 6) + 0.0 as sia_bert,
           round(sia_vader, 6) + 0.0 as sia_vader, round(sia, 6) + 0.0 as sia from scored""",
)
def write_scored(spark: SparkSession, sf: str) -> DataFrame:
    """The whole scored frame, stored and read again."""
    path = scratch_path(spark, "scored")
    writers.write_scored(_scored(spark, sf, keep_text=True), path)
    stored = _rounded(readers.read_scored(spark, path), "sia_bert", "sia_vader", "sia")
    return stored.select("source", "id", "title", "selftext", "text", "date", "score", "num_comments", "sia_bert", "sia_vader", "sia")


@query("write_daily", f"with {DAILY_CTE} select {DAILY_COLUMNS} from daily")
def write_daily(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "daily")
    writers.write_daily(daily.daily_sentiment(_scored(spark, sf), F.col("has_title")), path)
    stored = readers.read_daily(spark, path)
    return _rounded(stored, "sia_bert_sum", "sia_vader_sum", "sia_sum")


@query(
    "write_posts",
    f"with {fx.POSTS_CTE} select source, id, title, selftext, score, num_comments, date from posts",
)
def write_posts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "fetched")
    writers.write_posts(fx.posts(spark, sf).withColumn("community", F.col("source")), path)
    stored = readers.read_posts(spark, path, fmt="parquet")
    return stored.select("source", "id", "title", "selftext", "score", "num_comments", "date")


# --- cleaning -----------------------------------------------------------------------------------


@query(
    "fill_text_nulls",
    f"with {fx.RAW_POSTS_CTE} select id, coalesce(title, '') as title, coalesce(selftext, '') as selftext from raw_posts",
)
def fill_text_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fill_text_nulls(fx.raw_posts(spark, sf)).select("id", "title", "selftext")


@query(
    "build_text",
    f"with {fx.RAW_POSTS_CTE} select id, left(coalesce(title, '') || ' ' || coalesce(selftext, ''), 500) as text from raw_posts",
)
def build_text(spark: SparkSession, sf: str) -> DataFrame:
    return clean.build_text(fx.raw_posts(spark, sf)).select("id", "text")


@query(
    "cast_defaults",
    f"""with {fx.RAW_POSTS_CTE} select id, coalesce(num_comments, 0) as num_comments, coalesce(score, 1) as score,
    round(cast(coalesce(upvote_ratio, 1) as double), 6) as upvote_ratio from raw_posts""",
)
def cast_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return clean.cast_defaults(fx.raw_posts(spark, sf)).select("id", "num_comments", "score", _ratio())


@query("drop_missing_time", f"with {fx.RAW_POSTS_CTE} select id from raw_posts where created_utc is not null")
def drop_missing_time(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_missing_time(fx.raw_posts(spark, sf)).select("id")


@query("epoch_to_date", f"with {fx.RAW_POSTS_CTE} select r.id, case when created_utc is not null then p.date end as date "
       "from raw_posts r join posts p on r.id = cast(p.id as varchar)")
def epoch_to_date(spark: SparkSession, sf: str) -> DataFrame:
    return clean.epoch_to_date(fx.raw_posts(spark, sf)).select("id", "date")


@query("iso_to_date", f"with {fx.MESSAGES_CTE} select id, date from messages")
def iso_to_date(spark: SparkSession, sf: str) -> DataFrame:
    return clean.iso_to_date(fx.messages(spark, sf)).select("id", "date")


@query("flatten_rich_text", f"with {fx.MESSAGES_CTE} select id, text from messages")
def flatten_rich_text(spark: SparkSession, sf: str) -> DataFrame:
    return clean.flatten_messages(fx.messages(spark, sf)).select("id", "text")


CHAT_COLUMNS = ("source", "id", "date", "title", "selftext", "num_comments", "score")


@query(
    "unify_source",
    f"""with {fx.MESSAGES_CTE} select source, id, date, text as title, '' as selftext, 0 as num_comments, 1 as score,
    1.0::double as upvote_ratio from messages""",
)
def unify_source(spark: SparkSession, sf: str) -> DataFrame:
    return flows.chat_posts(fx.messages(spark, sf)).select(*CHAT_COLUMNS, F.col("upvote_ratio").cast("double").alias("upvote_ratio"))


@query("drop_marked", f"with {fx.POSTS_CTE}, {CLEAN_CTE} select source, id, title from clean")
def drop_marked(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_marked(fx.posts(spark, sf), fx.MARKERS).select("source", "id", "title")


@query(
    "cleaning_report",
    f"""with {fx.RAW_POSTS_CTE}, flagged as (
      select source, created_utc is null as timeless, score, coalesce(upvote_ratio, 0) as ratio,
             contains(coalesce(title, ''), 'license') or contains(coalesce(title, ''), '!')
             or contains(coalesce(selftext, ''), 'license') or contains(coalesce(selftext, ''), '!') as marked
      from raw_posts)
    select source, count(*) as posts_in, count(*) filter (marked) as marked,
           count(*) filter (timeless and not marked) as without_time,
           count(*) filter (not timeless and not marked) as kept,
           count(*) filter (not timeless and not marked and ratio = 0) as without_weight
    from flagged group by source""",
)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_posts(spark, sf)
    ratio = F.coalesce(F.col("upvote_ratio").try_cast("double"), F.lit(0.0))
    typed = clean.cast_defaults(clean.epoch_to_date(raw).withColumn("upvote_ratio", ratio))
    return clean.cleaning_report(typed, fx.MARKERS)


@query(
    "dedupe_posts",
    f"""with {fx.POSTS_CTE}, copies as (
      select source, id, title, num_comments, score from posts
      union all select source, id, title, num_comments, score + cast(id % 3 as int) - 1 from posts)
    select source, id, any_value(title) as title, max(num_comments) as num_comments, max(score) as score
    from copies group by source, id""",
)
def dedupe_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = fx.posts(spark, sf).select("source", "id", "title", "num_comments", "score")
    copies = posts.unionByName(posts.withColumn("score", (F.col("score") + F.col("id") % 3 - 1).cast("int")))
    return clean.dedupe_posts(copies)


@query(
    "select_features",
    f"with {fx.PRICES_CTE} select series_id as source, date, close, volume, high from prices",
)
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    prices = fx.prices(spark, sf).withColumnRenamed("series_id", "source")
    return clean.select_features(prices, "close", ["volume", "close", "high"])


@query(
    "strip_prefix",
    f"""with {fx.INDICATORS_CTE} select round(closing_price, 6) as "Closing Price", active_addr_cnt as "Active Addr Cnt",
    tx_cnt as "Tx Cnt" from indicators""",
)
def strip_prefix(spark: SparkSession, sf: str) -> DataFrame:
    named = fx.indicators(spark, sf).select(
        "date",
        F.round("closing_price", 6).alias("BTC / Closing Price"),
        F.col("active_addr_cnt").alias("BTC / Active Addr Cnt"),
        F.col("tx_cnt").alias("BTC / Tx Cnt"),
    )
    return clean.strip_prefix(named)


@query(
    "union_sources",
    f"""with {fx.POSTS_CTE}, {fx.MESSAGES_CTE}
    select source, id, date, title, score, created from posts
    union all select source, id, date, text, 1, null from messages""",
)
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    chat = flows.chat_posts(fx.messages(spark, sf)).select("id", "source", "date", "title", "score")
    return clean.union_sources(fx.posts(spark, sf).select("source", "id", "date", "title", "score", "created"), chat)


@query(
    "fetch_windows",
    """with counted as (
      select o_orderpriority as source, cast(date_trunc('year', o_orderdate) as date)
             + cast(floor((dayofyear(o_orderdate) - 1) / 5) * 5 as int) as window_start, count(*) as n
      from orders group by 1, 2),
    spine as (
      select source, cast(y as date) + cast(s as int) as window_start, cast(y as date) as y
      from (select source, min(window_start) as lo, max(window_start) as hi from counted group by source) b,
           unnest(generate_series(date_trunc('year', lo), cast(hi as timestamp), interval 1 year)) as ys(y),
           unnest(generate_series(0, 365, 5)) as ss(s)
      where cast(y as date) + cast(s as int) between lo and hi and year(cast(y as date) + cast(s as int)) = year(y))
    select source, cast(window_start as date) as window_start,
           cast(least(window_start + 5, y + interval 1 year) as date) as window_end, coalesce(n, 0) as n
    from spine left join counted using (source, window_start)""",
)
def fetch_windows(spark: SparkSession, sf: str) -> DataFrame:
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("date")
    )
    return clean.fetch_windows(orders)


# --- joins --------------------------------------------------------------------------------------

MARKET_COLUMNS = """round(closing_price, 6) as closing_price, active_addr_cnt, tx_cnt,
    round(case when closing_price > 0 then ln(closing_price) end, 6) as log_price"""


@query(
    "join_indicators",
    f"with {DAILY_CTE}, {fx.INDICATORS_CTE} select {DAILY_COLUMNS}, {MARKET_COLUMNS} from daily left join indicators using (date)",
)
def join_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Posts to daily features: clean, score, weight, sum per day and join the market metrics."""
    features = flows.daily_features(_scored(spark, sf), fx.indicators(spark, sf))
    return _rounded(features, "sia_bert_sum", "sia_vader_sum", "sia_sum", "closing_price", "log_price")


@query(
    "join_prices",
    f"""with {INDICATED_CTE}
    select p.series_id as source, p.date, p.low, i.close, i.volume, round(macd, 3) + 0.0 as macd,
           round(signal, 3) + 0.0 as signal, round(ema, 3) as ema, round(rsi, 6) as rsi
    from (select series_id, cast(date + 400 as date) as date, low from prices) p left join indicated i on p.date = i.date""",
)
def join_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The features run 400 days ahead, so their last days have no prices."""
    features = fx.prices(spark, sf).select(
        F.col("series_id").alias("source"), F.date_add("date", 400).alias("date"), "low", F.lit(0.0).alias("macd"), F.lit(0.0).alias("volume")
    )
    computed = series.price_indicators(fx.prices(spark, sf).select("series_id", "date", "close", "volume"))
    joined = daily.join_prices(features, computed, "orders")
    rounded = _rounded(joined, "macd", "signal", digits=3)
    return rounded.withColumns({"ema": F.round("ema", 3), "rsi": F.round("rsi", 6)})


@query(
    "merge_lexicon",
    f"""with {fx.LEARNED_LEXICON_CTE}, {fx.LEXICON_CTE}
    select coalesce(d.term, b.term) as term, coalesce(d.polarity, b.polarity) as polarity
    from learned b full join lexicon d on b.term = d.term""",
)
def merge_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.merge_lexicon(fx.learned_lexicon(spark, sf), fx.lexicon(spark))


@query(
    "lexicon_lookup",
    f"""with {fx.POSTS_CTE}, {fx.LEARNED_LEXICON_CTE}, words as (
      select source, id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as t
      from (select source, id, {WORDS.format(text="title || ' ' || selftext")} as w from posts))
    select source, id, cast(pos as int) as pos, term, polarity
    from words join learned on term = lower({BARE.format(t="t")})""",
)
def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every hit of a learned lexicon in the whole texts."""
    texts = clean.build_text(fx.posts(spark, sf), limit=None).select("source", "id", "text")
    return lexicon.lexicon_lookup(texts, materialise(fx.learned_lexicon(spark, sf)))


@query(
    "chat_daily_features",
    f"""with {fx.MESSAGES_CTE}, {MERGED_CTE}, {fx.INDICATORS_CTE},
    texts as (select source, id, text || ' ' as text from messages),
    {CONTEXT_CTE},
    {TOTALS_CTE},
    {classifier_cte("texts")},
    parts as (
      select m.source, date, m.text, 2 * p - 1 as sia_bert, s / sqrt(s * s + 15) as sia_vader
      from messages m join totals using (source, id) join classified using (source, id)),
    daily as (
      select source, date, sum(sia_bert) as sia_bert_sum, sum(sia_vader) as sia_vader_sum,
             sum(({flows.CHAT_MODEL_SHARE} * sia_bert + {1 - flows.CHAT_MODEL_SHARE} * sia_vader) / (1 + exp(-0.1))) as sia_sum,
             count(nullif(text, '')) as num_posts, cast(0 as bigint) as num_comments
      from parts group by source, date)
    select {DAILY_COLUMNS}, {MARKET_COLUMNS} from daily left join indicators using (date)""",
)
def chat_daily_features(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages to daily features, uncut texts and constant engagement."""
    chat = flows.chat_posts(fx.messages(spark, sf))
    terms, classifier = artefacts.merged_lexicon(spark, sf), artefacts.word_classifier(spark, sf)
    scored = flows.score_posts(chat, terms, flows.CHAT_MODEL_SHARE, classifier, limit=None)
    features = flows.daily_features(scored, fx.indicators(spark, sf))
    return _rounded(features, "sia_bert_sum", "sia_vader_sum", "sia_sum", "closing_price", "log_price")
