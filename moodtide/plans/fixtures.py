"""Views that give the test tables the shape of posts, prices, metrics, messages and lexicons.

Each view exists twice: as a DataFrame, and as a common table expression for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.session import spread

#: Polarities of the test lexicon.
LEXICON = {"the": 0.1, "of": -0.2, "and": 0.35, "to": -0.45, "that": 0.5, "was": -0.6, "with": 0.75, "for": -0.1}
#: Emoji of one and of several code points, and what they are called.
EMOJI = {
    "\U0001F44D": "thumbs up",
    "\U0001F44D\U0001F3FD": "thumbs up with a medium skin tone",
    "\U0001F469": "woman",
    "\U0001F469\u200D\U0001F680": "the astronaut",
    "\u2764": "heart",
    "\u2764\uFE0F": "heart that was red",
    "\U0001F1E9\U0001F1EA": "flag for a country",
    "\U0001F600": "face to grin with",
    "*\uFE0F\u20E3": "key of a star",
}
MARKERS = ("license", "!")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their texts, spread over all cores: a text costs far more to read than to move."""
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars"), "doc_id")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON.items()), "term string, polarity double")


def emoji(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EMOJI.items()), "emoji string, description string")


def emoji_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 characters of each document with two emoji in them, one behind a letter, some behind one another."""
    keys = F.array(*[F.lit(k) for k in [*EMOJI, "\U0001F3FD"]])  # the last one, a tone alone, is in no table
    first, second = (F.element_at(keys, (F.col("doc_id") % m + 1).cast("int")) for m in (len(EMOJI) + 1, 7))
    gap = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 31, 70))
    planted = F.concat(F.substring("text", 1, 30), first, gap, second, F.substring("text", 101, 100))
    return documents(spark, sf).select("source", F.col("doc_id").alias("id"), planted.alias("text"))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """One post per document; engagement and time come from an event."""
    texts = documents(spark, sf).select("doc_id", "source", "text")
    events = table(spark, sf, "events").select("event_id", "ts", "value", "props")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return texts.join(events, F.col("event_id") == F.col("doc_id") * 5).select(
        F.col("doc_id").alias("id"),
        "source",
        F.substring("text", 1, 80).alias("title"),
        F.expr("substring(text, 81)").alias("selftext"),
        F.floor("value").cast("int").alias("score"),
        k.alias("num_comments"),
        ((F.lit(50) + k % 51) / 100.0).cast("float").alias("upvote_ratio"),
        F.col("ts").alias("created"),
        F.col("ts").cast("date").alias("date"),
    )


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts as a file holds them: numbers as text, some values missing or unreadable."""
    i = F.col("id")
    created = F.unix_date("date") * F.lit(86400).cast("bigint") + F.hour("created") * 3600 + F.minute("created") * 60 + F.second("created")
    ratio = F.format_string("0.%02d", 50 + F.col("num_comments") % 50)

    def unless(condition: Column, value: Column) -> Column:
        return F.when(~condition, value)

    return posts(spark, sf).select(
        i.cast("string").alias("id"),
        F.concat(F.lit("http://post/"), i).alias("url"),
        unless(i % 7 == 3, F.col("title")).alias("title"),
        F.when(i % 13 == 1, "").when(i % 13 == 2, F.concat("score", F.lit(".0"))).otherwise(F.col("score").cast("string")).alias("score"),
        unless(i % 5 == 2, F.col("num_comments").cast("string")).alias("num_comments"),
        unless(i % 19 == 6, created.cast("string")).alias("created_utc"),
        unless(i % 11 == 5, F.col("selftext")).alias("selftext"),
        F.when(i % 17 == 4, "unknown").otherwise(ratio).alias("upvote_ratio"),
        "source",
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat messages; every second text is an array of parts with a link between them."""
    text = F.col("text")
    link = F.parse_json(F.lit('{"type": "link", "text": "http://x"}'))
    halves = [F.substring(text, 1, 10), F.expr("substring(text, 11)")]
    parts = F.to_variant_object(F.array(halves[0].cast("variant"), link, halves[1].cast("variant")))
    value = F.when(F.col("turn") % 2 == 1, parts).otherwise(text.cast("variant"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int"))
    return table(spark, sf, "conversations").select(
        F.lit("chat").alias("source"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(day.cast("string"), F.lit("T"), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("date"),
        value.alias("text"),
    )


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """A daily price series from order totals."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"))
    return (
        orders.groupBy("date")
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select(F.lit("orders").alias("series_id"), "date", "open", "high", "low", "close", "volume")
    )


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Daily market metrics from purchases. Every seventh day of a month is left out of this view, so that joins have misses."""
    day = F.col("ts").cast("date")
    return (
        table(spark, sf, "events")
        .where((F.col("event_type") == "purchase") & (F.dayofmonth("ts") % 7 != 0))
        .groupBy(day.alias("date"))
        .agg(
            F.avg("value").alias("closing_price"),
            F.count_distinct("user_id").alias("active_addr_cnt"),
            F.count(F.lit(1)).alias("tx_cnt"),
        )
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    texts = documents(spark, sf).select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return texts.join(labels, "doc_id")


def learned_lexicon(spark: SparkSession, sf: str, min_letters: int = 3, min_documents: int = 5) -> DataFrame:
    """Terms of ``min_letters`` and ``min_documents`` labelled documents with the mean label of those in [-1, 1]."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    return (
        labelled(spark, sf)
        .select("label", F.explode(words).alias("term"))
        .where(F.length("term") >= min_letters)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
        .where(F.col("n") >= min_documents)
        .select("term", F.round(F.col("good") * 2.0 / F.col("n") - 1.0, 2).alias("polarity"))
    )


# --- the same views as SQL ---------------------------------------------------------------------

LEXICON_CTE = "lexicon(term, polarity) as (values " + ", ".join(f"('{t}', {p}::double)" for t, p in LEXICON.items()) + ")"

POSTS_CTE = """posts as (
  select d.doc_id as id, d.source, left(d.text, 80) as title, substring(d.text, 81) as selftext,
         cast(floor(e.value) as int) as score,
         cast(regexp_extract(e.props, '([0-9]+)', 1) as int) as num_comments,
         cast((50 + cast(regexp_extract(e.props, '([0-9]+)', 1) as int) % 51) / 100.0 as float) as upvote_ratio,
         e.ts as created, cast(e.ts as date) as date
  from documents d join events e on e.event_id = d.doc_id * 5)"""

EMOJI_TEXTS_CTE = f"""emoji(emoji, description) as (values {", ".join(f"('{k}', '{v}')" for k, v in EMOJI.items())}),
    emoji_texts as (
      select source, doc_id as id,
             left(text, 30) || [{", ".join(f"'{k}'" for k in [*EMOJI, chr(0x1F3FD)])}][doc_id % {len(EMOJI) + 1} + 1]
             || case when doc_id % 3 = 0 then '' else substring(text, 31, 70) end
             || [{", ".join(f"'{k}'" for k in EMOJI)}][doc_id % 7 + 1] || substring(text, 101, 100) as text from documents)"""

RAW_POSTS_CTE = (
    POSTS_CTE
    + """, raw_posts as (
  select cast(id as varchar) as id, source,
         case when id % 7 <> 3 then title end as title,
         case when id % 11 <> 5 then selftext end as selftext,
         case when id % 13 = 1 then null else score end as score,
         case when id % 5 <> 2 then num_comments end as num_comments,
         case when id % 19 <> 6 then cast(floor(epoch(created)) as bigint) end as created_utc,
         case when id % 17 <> 4 then cast((50 + num_comments % 50) / 100.0 as float) end as upvote_ratio
  from posts)"""
)

MESSAGES_CTE = """messages as (
  select 'chat' as source, conv_id * 1000 + turn as id,
         cast(date '2024-01-01' + cast(conv_id % 30 as int) as date) as date,
         case when turn % 2 = 1 then left(text, 10) || ' ' || substring(text, 11) else text end as text
  from conversations)"""

PRICES_CTE = """prices as (
  select 'orders' as series_id, cast(o_orderdate as date) as date,
         arg_min(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
         arg_max(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume
  from orders group by cast(o_orderdate as date))"""

INDICATORS_CTE = """indicators as (
  select cast(ts as date) as date, avg(value) as closing_price, count(distinct user_id) as active_addr_cnt, count(*) as tx_cnt
  from events where event_type = 'purchase' and day(ts) % 7 <> 0 group by cast(ts as date))"""

LEARNED_LEXICON_CTE = """learned as (
  select term, round(sum(label) * 2.0 / count(*) - 1.0, 2) as polarity
  from (select l.doc_id, l.quality as label, unnest(list_distinct(regexp_extract_all(lower(d.text), '[a-z]+'))) as term
        from documents d join labels l using (doc_id)) t
  where length(term) >= 3 group by term having count(*) >= 5)"""
