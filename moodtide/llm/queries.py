"""Registered queries of the operators, each over the whole table, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import alignment, bpe, credentials, jaccard, langid, mixing, packing, parsing, passages, pii, scoring, search, spelling
from moodtide.plans.registry import query

TOKENIZER = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def encoded(spark: SparkSession, docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the ids of each text, with the digests of the ids and of the bytes they decode to."""
    ranks = bpe.read_ranks(spark, public_tokenizers.path(TOKENIZER))
    ids = docs.select(*columns, bpe.encode(F.col("text"), ranks, public_tokenizers.PATTERN).alias("ids"))
    both = ids.withColumn("decoded", bpe.decode(F.col("ids"), ranks, public_tokenizers.PATTERN))
    return both.select(
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


@query("op2_bpe_codec")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, table(spark, sf, "documents"), ["doc_id"]).drop("ids")


def span_text(spans: F.Column, base_only: int | None = None) -> F.Column:
    """kind:start:stop of each span, joined by commas."""
    kept = spans if base_only is None else F.filter(spans, lambda s: s["kind_no"] < base_only)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


OP3_SQL = r"""
with spans as (
  select doc_id, source, row_number() over () as rid, coalesce(text, '') as text from documents
), raw as (
  select rid, doc_id, source, 0 as kind_no, 'assign' as kind,
         regexp_extract_all(text, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 1) as gap,
         regexp_extract_all(text, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 2) as head,
         regexp_extract_all(text, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 3) as body from spans
  union all
  select rid, doc_id, source, 1, 'access', regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1), null,
         regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2) from spans
  union all
  select rid, doc_id, source, 2, 'hex', regexp_extract_all(text, '(?s)(.*?)([0-9a-f]{16,})', 1), null,
         regexp_extract_all(text, '(?s)(.*?)([0-9a-f]{16,})', 2) from spans
  union all
  select rid, doc_id, source, 3, 'other', regexp_extract_all(text, '(?s)(.*?)(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[A-Za-z0-9+/_-]{24,})', 1), null,
         regexp_extract_all(text, '(?s)(.*?)(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[A-Za-z0-9+/_-]{24,})', 2) from spans
), each as (
  select rid, doc_id, source, kind_no, kind, unnest(range(1, len(body) + 1)) as nth, gap, head, body from raw where len(body) > 0
), sized as (
  select rid, doc_id, source, kind_no, kind, nth, length(gap[nth]) as gap, coalesce(length(head[nth]), 0) as head, body[nth] as body from each
), placed as (
  select *, sum(gap + head + length(body)) over (partition by rid, kind_no order by nth) as stop from sized
), found as (
  select rid, doc_id, source, kind_no, kind, body, stop, stop - head - length(body) as start from placed
  where length(body) >= case kind_no when 0 then 12 when 1 then 18 when 2 then 16 else 13 end
    and (kind_no < 3 or regexp_matches(body, '^(eyJ|gh[pousr]_|xox[abprs]-)') or (regexp_matches(body, '[0-9]') and regexp_matches(body, '[A-Z]') and regexp_matches(body, '[a-z]')))
), owners as (
  select body, sum(n)::bigint as repositories, count(*) as owners from (
    select body, source, count(distinct coalesce('d' || doc_id::varchar, 'none')) as n from found group by body, source) group by body
), judged as (
  select f.*, owners, repositories, owners = 1 and repositories <= 5 as live from found f join owners o on f.body = o.body
  where kind_no < 3 or (owners = 1 and repositories <= 5)
), lists as (
  select rid, count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access, count(*) filter (kind_no = 2) as n_hex,
         count(*) filter (live) as n_live, max(owners) as most_owners, max(repositories) as most_repositories,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind_no) filter (kind_no < 3) as base,
         string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind_no) as spans
  from judged group by rid
)
select s.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(l.spans, '') as spans, coalesce(n_live, 0) as n_live,
       coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories
from spans s left join lists l on s.rid = l.rid
"""


@query("op3_secrets", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a repository of its own here, its source the owner."""
    found = credentials.scan(table(spark, sf, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(span_text(spans, credentials.BASE), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        *[F.coalesce(F.array_max(F.transform(spans, lambda s: s[c])), F.lit(0)).alias(f"most_{c}") for c in ("owners", "repositories")],
    )


OP5_SQL = r"""
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size, count(*) as documents from docs group by source
), ranked as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from totals
), rounds as (
  select 0 as round, source, source_size, documents, weight, false as full_up from ranked
  union all
  select round + 1, source, source_size, documents, weight,
         full_up or (1.5 * sum(source_size) over () - 2.0 * sum(case when full_up then source_size else 0 end) over ())
           * weight / sum(case when full_up then 0 else weight end) over () >= 2.0 * source_size
  from rounds where round <= (select count(*) from ranked)
), targets as (
  select source, source_size, documents,
         case when full_up then 2.0 * source_size else
           (1.5 * sum(source_size) over () - 2.0 * sum(case when full_up then source_size else 0 end) over ())
             * weight / sum(case when full_up then 0 else weight end) over () end::double as target
  from rounds where round = (select max(round) from rounds)
), seats as (
  select *, floor(sum(target) over () / 16 + 0.5)::bigint as h from targets
), quotients as (
  select source, target / (2 * k + 1) as q, h from (
    select source, target, h, unnest(range(0, floor(target / 16)::bigint + 30)) as k from seats)
), won as (
  select source, count(*) as blocks from (
    select source, h, row_number() over (order by q desc, source nulls last) as r from quotients) where r <= h group by source
), quotas as (
  select s.*, coalesce(w.blocks, 0) as blocks, ceil(documents / 10000.0)::bigint as shards
  from seats s left join won w on s.source is not distinct from w.source
), placed as (
  select d.doc_id, d.source, d.size, q.source_size, q.target, q.blocks,
         ('0x' || substr(md5(concat_ws('|', 'mix-1-shard', d.doc_id::varchar)), 1, 8))::bigint % q.shards as shard
  from docs d join quotas q on d.source is not distinct from q.source
), shards as (
  select source, shard, sum(size)::bigint as shard_size, max(blocks) as blocks from placed group by source, shard
), dealt as (
  select source, shard, shard_size, sum(case when r <= blocks then 1 else 0 end) as quota from (
    select *, row_number() over (partition by source order by shard_size / (2 * k + 1) desc, shard) as r from (
      select *, unnest(range(0, blocks + 1)) as k from shards)) group by source, shard, shard_size
), line as (
  select p.*, d.shard_size, greatest(d.shard_size, 1) as n, least(d.quota * 16, d.shard_size * 2) as words,
         sum(size) over (partition by p.source, p.shard
           order by ('0x' || substr(md5(concat_ws('|', 'mix-1', doc_id::varchar)), 1, 8))::bigint, doc_id, size
           rows unbounded preceding) - size as b
  from placed p join dealt d on p.source is not distinct from d.source and p.shard = d.shard
), cut as (
  select *, words // n as passes,
         (('0x' || substr(md5(concat_ws('|', 'mix-1-start', coalesce(source, ''), shard::varchar)), 1, 8))::bigint % ceil(n / 16.0)::bigint) * 16 as f
  from line
), ends as (select *, f + words % n as t from cut)
select doc_id, size, source_size, target,
       (passes * size + least(greatest(least(t, n) - b, 0), size) - least(greatest(f - b, 0), size)
        + least(greatest(greatest(t - n, 0) - b, 0), size))::bigint as taken
from ends
"""


@query("op5_mixing", OP5_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_pii")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = docs.select("doc_id", pii.spans(F.col("text"), pii.fit(docs)).alias("spans"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS[: pii.BASE]],
        F.sha2(span_text(spans, pii.BASE), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


@query("op6_fingerprints")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    pairs = parsing.with_next(docs, "doc_id", ["text"], {"print": parsing.fingerprint(F.col("text"))})
    pairs = pairs.withColumn("edited", parsing.edited(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("edited_print", parsing.fingerprint(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        parsing.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        parsing.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


@query("op7_language")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", langid.fold(F.col("doc_id"), 3) == 1)
    filters = langid.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    found = docs.select("doc_id", "held_out", langid.predict(F.col("text"), filters).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


OP9_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), each as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from words where len(w) > 0
), sets as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s from each
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared >= 85 * (p.n + q.n - shared)
), ways as (select x, y from links union all select y, x from links
), reach as (
  select doc_id as node, doc_id as seen from words union select r.node, w.y from reach r join ways w on r.seen = w.x
), least as (select node, min(seen) as component_id from reach group by node)
select w.doc_id, coalesce(n, 0) as n_shingles, component_id from words w join least on node = w.doc_id left join sizes s on s.doc_id = w.doc_id
"""


@query("op9_jaccard", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link(table(spark, sf, "documents").select("doc_id", "text"))


@query("op10_neighbours")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@query("op8_scoring")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scoring.score(docs, langid.fold(F.col("doc_id"), 5) != 1)


@query("op1_passages")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return passages.find(table(spark, sf, "documents").select("doc_id", "text"))


OP11_SQL = r"""
with recursive crc_bits as (
  select range::bigint as i, range::bigint as c, 0 as k from range(256)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8
), crc_table as (
  select list(c order by i) as t from crc_bits where k = 8
), runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) as run from documents
), distinct_runs as (
  select doc_id, run, count(*) as m from runs where length(run) >= 7 group by doc_id, run
), hashed as (
  select run, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(coalesce(doc_id::varchar, '') || ':' || run))), lambda j: ('0x' || substr(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), 2 * j + 1, 2))::bigint)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h
  from distinct_runs, crc_table
), words as (
  select word, sum(m)::bigint as n from (
    select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, m from hashed)
  where length(word) >= 7 group by word having sum(m) >= 2
), cuts as (
  select distinct word, n, substr(word, 1, i::int) || substr(word, i::int + 2) as cut, i from (select word, n, unnest(range(length(word))) as i from words)
), pairs as (
  select a.word as a, b.word as b, b.n as m from cuts a join cuts b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union
  select c.word, w.word, w.n from cuts c join words w on c.cut = w.word
  union
  select w.word, c.word, c.n from cuts c join words w on c.cut = w.word
), best as (
  select a, count(*) as n_near, max(m) as m, arg_min(b, (-m, b)) as b from pairs group by a
), forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then b end as form, case when m >= 10 * n then m end as form_n
  from words left join best on a = word
), walk as (
  select word, word as now, 0 as steps from forms
  union all
  select k.word, f.form, steps + 1 from walk k join forms f on f.word = k.now where f.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from forms f join (select word, arg_max(now, steps) as root from walk group by word) r on r.word = f.word
"""


@query("op11_spelling", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Words as the contract alters them: a run in a document whose checksum 31 divides loses a letter. A null id counts as ''."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run")).where(F.char_length("run") >= 7)
    checksum = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("checksum") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    words = found.withColumn("checksum", checksum).select(F.when(F.col("checksum") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelling.group(spelling.vocabulary(words))


@query("op12_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    files = [bpe.read_ranks(spark, public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.measures(table(spark, sf, "documents"), *files, ["doc_id"])


@query("op13_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    file = bpe.read_ranks(spark, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(packing.pieces(table(spark, sf, "documents"), file, ["doc_id"]))
