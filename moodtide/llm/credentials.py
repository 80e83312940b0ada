"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates: the three base kinds (assign, access, hex) and a wide net of other formats.
A candidate's credential is hashed; the hashes are counted over the whole corpus by distinct
repositories and owners. A credential that several owners have is a widely copied example, and so is one
that its only owner has in more than ``REPOSITORIES`` repositories, as a template or a vendored file is; one that a single
owner has in so many or fewer looks live. The wide net's candidates are reported only where they look live,
the base kinds always. The net's prefixed formats are secrets whatever their letters; its unprefixed runs must hold a
digit, a capital and a small letter.

Defined results: a null text is the empty text, a null owner or repository counts as one more value,
repeated rows are reported each and count once, texts of any length are read whole, an empty table gives an empty
result; other columns, of any names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodtide.session import materialise

#: Kinds in the order of the report: name, the text before the credential, the credential, its least length.
#: A run is matched whole, so a least length inside the pattern finds the same runs where nothing stands before it.
KINDS = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 12),
    ("access", "", "AKIA[A-Z0-9]{14,}", 18),
    ("hex", "", "[0-9a-f]{16,}", 16),
    ("other", "", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[A-Za-z0-9+/_-]{24,}", 13),
)
BASE = 3
#: A prefix that makes a candidate of the wide net a secret of its kind, whatever its letters: fixed values.
PREFIXED = "^(eyJ|gh[pousr]_|xox[abprs]-)"
#: Most repositories of its only owner in which a credential looks live.
REPOSITORIES = 5
#: The join of occurrences and verdicts deals each credential to so many tasks.
SALTS = 16


def _matches(text: Column, head: str, body: str) -> Column:
    """All matches from left to right as array<struct<gap, head, body>>: text before the match, its head, its credential."""
    # each match begins where the last one ended, with the shortest gap that lets the pattern match
    pattern = F.lit(rf"\G([\s\S]*?)({head})({body})")
    parts = [F.regexp_extract_all(text, pattern, F.lit(k)) for k in (1, 2, 3)]
    found = F.arrays_zip(parts[0].alias("gap"), parts[1].alias("head"), parts[2].alias("body"))
    sized = F.transform(
        found,
        lambda m: F.struct(
            F.length(m["gap"]).alias("gap"),
            F.length(m["head"]).alias("head"),
            F.length(m["body"]).alias("body"),
            F.sha2(m["body"], 256).alias("hash"),
            (m["body"].rlike(PREFIXED) | m["body"].rlike("[0-9]") & m["body"].rlike("[A-Z]") & m["body"].rlike("[a-z]")).alias("mixed"),
        ),
    )
    return F.when(text.rlike(head + body), sized).otherwise(F.array().cast("array<struct<gap:int,head:int,body:int,hash:string,mixed:boolean>>"))


def scan(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, its spans, and how many credentials look live or are widely copied.

    spans: array<struct<start, kind_no, kind, stop, live, owners, repositories>>, by start and kind; code points, stop exclusive.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # the one pass over the texts; all that follows reads its narrow result
    rows = materialise(
        docs.select(
            F.col(key).alias("key"),
            F.col(repository).cast("string").alias("repository"),
            F.col(owner).cast("string").alias("owner"),
            F.monotonically_increasing_id().alias("row"),
            *[_matches(whole, head, body).alias(name) for name, head, body, _ in KINDS],
        )
    )
    numbered = lambda no: lambda m, i: F.struct(F.lit(no).alias("kind_no"), i.alias("at"), m.alias("m"))
    each = F.concat(*[F.transform(name, numbered(no)) for no, (name, *_) in enumerate(KINDS)])
    found = rows.select("row", "repository", "owner", F.explode(each).alias("e")).select("row", "repository", "owner", "e.kind_no", "e.at", "e.m.*")
    so_far = W.partitionBy("row", "kind_no").orderBy("at")  # the matches of one kind in one document
    stop = F.sum(F.col("gap") + F.col("head") + F.col("body")).over(so_far)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind_no") + 1)
    found = (
        found.withColumn("stop", stop)
        .withColumn("start", F.col("stop") - F.col("head") - F.col("body"))
        .where((F.col("body") >= least) & ((F.col("kind_no") < BASE) | F.col("mixed")))
    )
    copies = (
        found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    judged = found.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int")).join(copies, ["hash", "salt"])
    judged = judged.withColumn("live", (F.col("owners") == 1) & (F.col("repositories") <= REPOSITORIES)).where((F.col("kind_no") < BASE) | F.col("live"))
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind_no") + 1)
    spans = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", kind.alias("kind"), "stop", "live", "owners", "repositories"))).alias("spans")
    )
    nothing = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "key").join(spans, "row", "left").select(F.col("key").alias(key), F.coalesce("spans", nothing).alias("spans"))
