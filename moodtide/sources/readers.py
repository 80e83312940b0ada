"""Readers for post files, chat exports, market tables, labelled sentences and lexicons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from moodtide import schemas

#: Text between two messages of an export indented by one blank per level.
INDENTED_MESSAGE_BREAK = "\n  },\n  {\n"


def _csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV with a header, every column as text and known by its name.

    Files of one path must have the same header; Spark checks that instead of going by position.
    """
    reader = spark.read.options(header=True, inferSchema=False, enforceSchema=False, **options)
    names = reader.csv(path).columns
    # a column without a name, as an index has, is called _c and its place by Spark but blank in the header
    blank = [StructField("" if c == f"_c{i}" else c, StringType()) for i, c in enumerate(names)]
    return reader.schema(StructType(blank)).csv(path).withColumn("_file_name", F.col("_metadata.file_name")).toDF(*names, "_file_name")


def _named(raw: DataFrame, columns: dict[str, str], required: Sequence[str], *more: Column) -> DataFrame:
    """The named columns of a file by their header; one that must be there and is not is an error."""
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"the file lacks the columns {missing}; it has {raw.columns[:-1]}")
    found = [(F.col(f"`{c}`").try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()]
    return raw.select(*found, *more)


def _ddl(schema: str) -> dict[str, str]:
    return dict(part.split() for part in schema.split(", "))


def _number(name: str) -> Column:
    value = F.col(f"`{name}`").try_cast("double")
    return F.when(~F.isnan(value), value)


def _day(name: str) -> Column:
    """A date or time as text, or milliseconds since 1970."""
    value = F.col(f"`{name}`")
    millis = F.when(value.rlike(r"^-?[0-9]{9,}(\.0*)?$"), F.date_from_unix_date(F.floor(value.try_cast("double") / 86_400_000).cast("int")))
    return F.coalesce(millis, F.to_date(F.try_to_timestamp(value)))


def read_posts(
    spark: SparkSession, path: str, source: str | None = None, fmt: str = "csv", pattern: str = "*submissions.csv"
) -> DataFrame:
    """All post files below ``path``; ``community`` is the leading part of the file name.

    The pattern leaves out derived files such as ``*-sia.csv``. Columns are found by their header,
    whatever their order; further ones are left out, and a file without id, title or time is an error.

    ``source`` labels the rows and defaults to the community. Bodies hold line breaks and doubled
    quotes, which makes a CSV file unsplittable: store big sets as parquet (``write_posts``).
    """
    if fmt == "csv":
        raw = _csv(spark, path, multiLine="true", quote='"', escape='"', pathGlobFilter=pattern)
        name = F.regexp_extract("_file_name", r"^(.*?)-?submissions\.", 1)
        community = F.col("community") if "community" in raw.columns else name
        posts = _named(raw, _ddl(schemas.POST_FILE), ("id", "title", "created_utc"), community.alias("community"))
    else:
        posts = spark.read.format(fmt).load(path)
        if "community" not in posts.columns:
            name = F.col("_metadata.file_name")
            posts = posts.withColumn("community", F.regexp_extract(name, r"^(.*?)-?submissions\.", 1))
    return posts.withColumn("source", F.lit(source) if source else F.col("community"))


#: What a reader does with a record that is no valid JSON.
BROKEN = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}


def read_messages(spark: SparkSession, path: str, layout: str = "document", broken: str = "keep") -> DataFrame:
    """Chat messages ``(source, id, date, text)`` with ``text`` as VARIANT.

    A ``broken`` record, a line or a whole document by its layout, makes the reading ``fail``, is to ``drop``, or to ``keep`` as a
    row of nulls, as far as the layout has rows for it; ``chat_report`` counts such records.

    ``layout`` says how a file is laid out: ``document`` is one JSON object with a ``messages``
    array, parsed by one task per file; ``lines`` is one message per line; ``indented`` is the
    same document as ``document`` in the exporter's fixed indentation, which lets Spark split one
    huge file between tasks.
    """
    if broken not in BROKEN:
        raise ValueError(f"broken records fail, drop or keep, not {broken}")
    mode = {"mode": BROKEN[broken]}
    chat = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    if layout == "lines":
        return spark.read.options(**mode).schema(schemas.MESSAGE).json(path).select(chat.alias("source"), "id", "date", "text")
    if layout == "document":
        exports = spark.read.options(**mode).schema(schemas.CHAT_EXPORT).json(path, multiLine=True)
        messages = exports.select(chat.alias("source"), F.explode("messages").alias("m"))
    elif layout == "indented":
        opening = '"messages": [\n  {\n'
        value = F.col("value")
        pieces = spark.read.option("lineSep", INDENTED_MESSAGE_BREAK).text(path)
        # The first piece of a file carries the head of the document, or is all of it when there are no messages.
        filled = pieces.where(~value.startswith("{") | value.contains(opening))
        headless = F.when(value.startswith("{"), F.substring_index(value, opening, -1)).otherwise(value)
        body = F.regexp_replace(headless, r"(?s)\n  \}\s*\].*\z", "")
        messages = filled.select(
            chat.alias("source"),
            F.from_json(F.concat(F.lit("{"), body, F.lit("}")), schemas.MESSAGE, {"mode": BROKEN["fail" if broken == "fail" else "keep"]}).alias("m"),
        )
        if broken == "drop":
            messages = messages.where("m.id is not null or m.date is not null or m.text is not null")
    else:
        raise ValueError(f"unknown layout: {layout}")
    return messages.select("source", "m.id", "m.date", "m.text")


def detect_layout(spark: SparkSession, path: str) -> str:
    """The layout of the chat files below ``path``, by the first lines of one of them."""
    head = [r.value for r in spark.read.text(path).limit(4).collect()]
    first = head[0].strip() if head else ""
    if first.startswith("{") and first.endswith("}") and '"messages"' not in first:
        return "lines"
    return "indented" if first == "{" and all(line.startswith(" ") for line in head[1:] if line != "}") else "document"


def chat_report(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Per chat: its messages, those without a date, and the records that are no valid JSON.

    A record is a line in the layout ``lines``, a whole file otherwise. What a broken one holds is lost to
    ``read_messages``, or a row of nulls there, so this is to be looked at first.
    """
    chat = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("source")
    options = {"columnNameOfCorruptRecord": "_broken"}
    broken = F.col("_broken").isNotNull()
    if layout == "lines":
        rows = spark.read.schema(f"{schemas.MESSAGE}, _broken string").json(path, **options)
        parts = rows.select(chat, F.when(broken, 0).otherwise(1).alias("n"), (~broken & F.col("date").isNull()).cast("int").alias("u"), broken.alias("bad"))
    else:
        files = spark.read.schema(f"{schemas.CHAT_EXPORT}, _broken string").json(path, multiLine=True, **options)
        undated = F.size(F.filter("messages", lambda m: m["date"].isNull()))
        parts = files.select(chat, F.coalesce(F.size("messages"), F.lit(0)).alias("n"), F.coalesce(undated, F.lit(0)).alias("u"), broken.alias("bad"))
    counts = [F.sum(F.greatest("n", F.lit(0))).alias("messages"), F.sum(F.greatest("u", F.lit(0))).alias("undated"), F.count_if("bad").alias("broken")]
    return parts.groupBy("source").agg(*counts)


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Market metrics: ``date`` and the logical indicator columns the file has."""
    raw = _csv(spark, path)
    present = {name: logical for name, logical in schemas.INDICATOR_COLUMNS.items() if name in raw.columns}
    return raw.select(_day("Time").alias("date"), *[_number(n).alias(to) for n, to in present.items()])


def read_prices(spark: SparkSession, path: str, series_id: str = "price") -> DataFrame:
    """Daily open, high, low, close and volume of one series."""
    raw = _csv(spark, path)
    return raw.select(
        F.lit(series_id).alias("series_id"), _day("date").alias("date"), *[_number(n).alias(n) for n in schemas.PRICE_COLUMNS]
    )


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``sentence`` and 0/1 ``label`` with a header; quotes are plain characters."""
    return _named(_csv(spark, path, sep="\t", quote=""), _ddl(schemas.LABELLED), ("sentence", "label"))


def load_lexicon(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Lexicon ``(term, polarity)``; polarity text becomes a double and terms must be unique."""
    lexicon = _named(_csv(spark, path, escape='"'), {"term": "string", "polarity": "double"}, ("term", "polarity"))
    if check:
        doubled = lexicon.groupBy("term").count().where("count > 1").select("term").head(3)
        if doubled:
            raise ValueError(f"terms listed more than once: {[row.term for row in doubled]}")
    return lexicon


def load_emoji(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``emoji`` and ``description`` with a header; quotes are plain characters."""
    return _named(_csv(spark, path, sep="\t", quote=""), {"emoji": "string", "description": "string"}, ("emoji", "description"))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored posts as ``write_scored`` stored them, to go on from there."""
    return spark.read.parquet(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily features as ``write_daily`` stored them."""
    return spark.read.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all models and targets as ``write_predictions`` stored them."""
    return spark.read.parquet(path)


def normalise_records(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns in order and with their types; a column ``df`` lacks is null."""
    return df.select(
        *[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()]
    )
