"""A corpus pipeline: language, near copies, personal data, mixture, tokens.

Each stage takes the documents that its predecessor kept, as written and read again, and its decisions take
effect: texts in no language go, one document of each group of near copies stays, personal data is replaced,
sources are mixed to their weights, and what is left is encoded. All but the last return the columns of the
documents, whatever further columns those have.

Defined results: a null text is in no language and goes; a document without an id is never dropped as a
copy; equal rows of one id stay once; an empty table stays empty. Rows of an id with different texts are told
apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import jaccard, langid, mixing, pii, queries
from moodtide.plans.registry import query
from moodtide.session import materialise, scratch_path, small_side, with_global_position

#: Least share of a text's trigrams that its language has to own.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; learned from the labelled two thirds."""
    filters = langid.fit(docs.where(langid.fold(F.col("doc_id"), 3) != 1).select("text", "lang"))
    if not filters.langs:  # nothing to learn from, so nothing to judge by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(F.col("text"), filters)
    return docs.where((found["lang"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of linked documents."""
    given = docs.where("doc_id is not null")
    repeated = given.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        copies = _copies(docs)
        return docs.join(small_side(copies), "doc_id", "left_anti").select(docs.columns)
    # rows of one id are told apart by their texts: each id and text gets a number, in the order of the ids
    numbers = with_global_position(given.select("doc_id", F.sha2("text", 256).alias("_hash")).distinct(), ["doc_id", "_hash"], "_row")
    numbers = numbers.withColumnRenamed("doc_id", "_id")
    same = (F.col("doc_id") == F.col("_id")) & F.sha2("text", 256).eqNullSafe(F.col("_hash"))
    rows = docs.join(numbers, same, "left").drop("_id", "_hash")
    copies = _copies(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    kept = rows.join(small_side(copies), "_row", "left_anti")
    return kept.where("_row is not null").dropDuplicates(["_row"]).union(kept.where("_row is null")).select(docs.columns)


def _copies(docs: DataFrame) -> DataFrame:
    """The ids of documents that are linked with one of a lower id."""
    rows = jaccard.link(docs, size=5, percent=80)
    return materialise(rows.where("doc_id <> component_id").select("doc_id").distinct())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced; n_chars follows the text."""
    out = docs.withColumn("text", pii.redact(F.col("text"), pii.fit(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, and one for a part of it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of them and of what they decode to."""
    return queries.encoded(spark, docs, ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: The stages learn, search and tokenise; SQL cannot state them.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
