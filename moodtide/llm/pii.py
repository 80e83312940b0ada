"""Personal data: wide generators propose spans, boosted trees on format and context choose among them.

The four base kinds (email, ip, card, phone) are exact rules and always reported. Beyond them generators
with high recall propose spans that may overlap: spelled-out addresses, groups of digits, long colon
groups, account codes. Boosted trees score each proposal by its kind, its format and its surroundings.

Weak labels come from checks that the trees do not see. Proposals of the texts: an account code by its remainder mod 97,
a colon group by whether it is an IPv6 address, a spelled-out address by its last label, digits by being a date, a book
number, or part of a base match. Base matches are also rewritten where they stand: addresses are spelled out, phone numbers
lose their "+", digits become account codes with right check digits, and other digits become dates, book numbers, serial codes,
hardware addresses and times, which are no personal data. Equal rows are one with a count. A fifth of them, chosen by the hash of their
features, is held out; the training rows are a bounded sample by hash (``TRAIN_ROWS``) of the others, weighted by
their counts. All held-out rows calibrate, kind by kind, the score from which proposals are reported: the least score, in
steps of 1 / ``STEPS``, from which a share of ``PRECISION`` of the proposals is right, and from there half way down to the next
score that a held-out row has. A kind without such a
score, or with fewer than ``LEAST_HELD`` held-out rows, is not reported. ``Trees.quality`` states precision and recall of each kind.

Defined results: a null text is the empty text and has no spans, repeated rows are scanned each, an empty
table gives an empty result, and no kind beyond the base ones where nothing can be learned. Texts of any length are read
whole; columns of any name may stand beside the text. ``redact`` keeps a text without spans as it is, and null stays null.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.llm.arrays import release
from moodtide.llm.sampling import by_hash
from moodtide.llm.settings import bounded_batches
from moodtide.session import scratch_path

TRAIN_ROWS, PRECISION, TREES, DEPTH = 20_000, 0.98, 12, 4
#: Held-out rows are counted by score in so many steps, so that the driver sees few rows whatever their number.
STEPS = 10_000
#: Calibration of a kind needs so many rows; with fewer, it is not reported.
LEAST_HELD = 50
KINDS = ("email", "ip", "card", "phone", "hidden", "number", "ipv6", "account")
BASE = 4
#: Words in the 40 characters before a span that tell its kind: fixed values.
CONTEXT = ("mail", "contact", "phone", "tel", "call", "mobile", "fax", "card", "visa", "credit", "account", "iban", "ip", "host", "server", "ssn", "id", "no")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Before the sign up to four parts, joined by spelled-out dots.
_HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9._%+-]{1,64}){0,3}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]+)+", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,}+\)?(?:[\x20./()-]{1,2}[0-9]{2,}+)*(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
#: Groups of four and a short last one; a short one after a space has digits only, so that a next word is not taken in.
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}|\x20[0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}(?:[A-Z0-9]{3}|\x20[0-9]{3}))(?![0-9A-Za-z])")

Span = tuple[int, int, int, bool]  # start, kind, stop, whether its checks hold


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def base_matches(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, with the result of its checks."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, 0, free, True))
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        if text.count(".") > 2:
            out += [(m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            n = m.end() - m.start()
            digits = m[0].replace(" ", "").replace("-", "") if n >= 12 else ""
            if 12 <= len(digits) <= 19:
                out.append((m.start(), 2, m.end(), _luhn(digits)))
        if "+" in text:
            out += [(m.start(), 3, m.end(), 9 <= sum(c in "0123456789" for c in m[0]) <= 15) for m in _PHONE.finditer(text)]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Wide spans beyond the base kinds: start, kind, stop."""
    out = []
    low = "at]" in text or "at)" in text or " at " in text or "AT" in text
    if low and ("dot" in text or "DOT" in text):
        out += [(m.start(), 4, m.end()) for m in _HIDDEN.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if 7 <= sum(c in "0123456789" for c in m[0]) <= 24:
                out.append((m.start(), 5, m.end()))
        if text.count(":") > 2:
            out += [(m.start(), 6, m.end()) for m in _IPV6.finditer(text)]
        out += [(m.start(), 7, m.end()) for m in _ACCOUNT.finditer(text)]
    return out


def _no_card(text: str, match: Span) -> bool:
    """Whether a rejected run of digits begins as a phone number abroad does and no card: the rejection says nothing of it."""
    return match[1] == 2 and not match[3] and text.startswith("00", match[0])


def _judged(text: str, proposal: tuple[int, int, int], matches: list[Span]) -> bool:
    """Whether a base rule has judged all of a proposal: it lies inside a match, or is a number whose digits all do."""
    s, kind, e = proposal
    if kind == 5:  # a bracket around the digits makes no other number
        at = [i for i in range(s, e) if text[i] in "0123456789"]
        s, e = at[0], at[-1] + 1
    return any(m[0] <= s and e <= m[2] and not _no_card(text, m) for m in matches)


def features(text: str, start: int, stop: int, kind: int) -> list[float]:
    """Kind and format of the span and its surroundings; the checks that make the labels are not among them."""
    span, before, after = text[start:stop], text[max(0, start - 40) : start].lower(), text[stop : stop + 1]
    digits = [c for c in span if c in "0123456789"]
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    return [
        float(x)
        for x in (
            len(span), len(digits), len(digits) / len(span), len(groups), max(groups), min(groups), groups[0], groups[-1],
            span.count(" "), span.count("-"), span.count("."), span.count("("), span.count(":"), span.count("@"), span[0] == "+",
            sum(map(str.isupper, span)), sum(map(str.islower, span)), len(set(digits)), before[-1:].isspace() or start == 0,
            not after or after.isspace(), after in ".,;", before[-1:] in "\"'=(", len(set(groups)) == 1,
            *(word in before for word in CONTEXT), *(kind == k for k in range(BASE, len(KINDS))),
        )
    ]


WIDTH = len(features("0", 0, 1, BASE))


@dataclass
class Trees:
    """Boosted trees as arrays: per tree feature, threshold, left, right, value of its nodes; feature -1 is a leaf."""

    trees: list[tuple[np.ndarray, ...]]
    weights: list[float]
    #: The score from which a kind is reported; a kind that is not listed is not.
    least: dict[int, float] = field(default_factory=dict)
    #: Of each kind: held-out rows, precision and recall from that score on.
    quality: dict[str, tuple[int, float, float]] = field(default_factory=dict)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            node = np.zeros(len(rows), np.int64)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = np.where(rows[inner, feature[at]] <= threshold[at], left[at], right[at])
            total += weight * value[node]
        return 1 / (1 + np.exp(-2 * total))


def _arrays(model: GBTClassificationModel) -> tuple[list[tuple[np.ndarray, ...]], list[float]]:
    trees = []
    for tree in model.trees:
        rows: list[list[float]] = []

        def add(node, rows=rows) -> int:
            at = len(rows)
            rows.append([-1, 0, 0, 0, node.prediction()])
            if node.subtreeDepth():
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2:4] = [add(node.leftChild()), add(node.rightChild())]
            return at

        add(tree._java_obj.rootNode())
        columns = list(zip(*rows))
        trees.append(tuple(np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float))))
    return trees, list(model.treeWeights)


_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}$)(?![0-9])")


def _account_check(code: str) -> int:
    """Remainder mod 97 of an account code, its first four characters moved to the end and letters read as numbers."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _book_check(first: str) -> str:
    """The thirteenth digit of a book number."""
    return str(-sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(first)) % 10)


def known(text: str, proposal: tuple[int, int, int], matches: list[Span]) -> bool | None:
    """Whether a proposal is personal data, by a check of its kind; None where no check tells."""
    start, kind, stop = proposal
    span = text[start:stop]
    if kind == 4:
        return bool(re.search("[A-Za-z]{2,}$", span)) and bool(re.match(r".*?[A-Za-z]", span[: re.search(r"(?i)\bat\b", span).start()]))
    if kind == 6:
        try:
            return bool(ipaddress.IPv6Address(span))
        except ValueError:
            return False
    if kind == 7:
        return _account_check(span.replace(" ", "")) == 1
    digits = "".join(c for c in span if c in "0123456789")
    if _DATE.match(span.lstrip("(")) or (len(digits) == 13 and digits[:3] in ("978", "979") and _book_check(digits[:12]) == digits[12]):
        return False
    around = [m for m in matches if m[0] <= start and stop <= m[2] and not _no_card(text, m)]
    if any(m[1] == 3 and m[3] for m in around):
        return True
    return False if around and not any(m[3] for m in around) else None


def rewritten(span: str, kind: int) -> Iterator[tuple[int, str, bool]]:
    """What stands for a base match to learn the other kinds from: kind, span, whether it is personal data. Fixed by the match."""
    digest = hashlib.sha256(span.encode()).hexdigest()
    n, digits = int(digest[:8], 16), "".join(c for c in span if c in "0123456789")
    if kind == 0:
        local, domain = span.split("@")
        at, dot = ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"))[n % 4]
        yield 4, (local.replace(".", dot) if n & 4 else local) + at + domain.replace(".", dot), True
    elif kind == 1:
        a, b, c, d = (int(p) for p in span.split("."))
        year, month, day = f"{1990 + a % 40}", f"{b % 12 + 1:02d}", f"{c % 28 + 1:02d}"
        sign = "-/."[n % 3]
        yield 4, f"{a} at {b} dot {c}", False
        yield 5, (sign.join((year, month, day)) if n & 4 else sign.join((day, month, year))) + (f" {d % 24:02d}" if n & 8 else ""), False
        yield 5, f"{1900 + b % 100}-{2000 + d % 100}", False
        yield 6, ":".join(digest[i : i + 4].lstrip("0") or "0" for i in range(0, 32, 4)), True
        yield 6, ":".join(digest[i : i + 2] for i in range(0, 12, 2)) if n & 16 else f"{a % 24:02d}:{b % 60:02d}:{c % 60:02d}:{d % 25:02d}", False
    elif kind == 2:
        country, bank = ("DE", "GB", "FR", "NL", "ES", "PL")[n % 6], ("", "", "NWBK", "ABNA")[n // 8 % 4]
        body = bank + (digits + digits)[: (12, 14, 16, 18, 20)[n // 64 % 5]]
        code = f"{country}{98 - _account_check(country + '00' + body):02d}{body}"
        serial = chr(65 + n % 26) + chr(65 + n // 32 % 26) + digits[:2] + digest[8 : 8 + 4 * (3 + n // 1024 % 3)].upper()
        grouped = lambda code: " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if n & 1 << 20 else code
        yield 7, grouped(code), True
        yield 7, grouped(serial), _account_check(serial) == 1
        book = "978" + digits[:9]
        book += _book_check(book)
        yield 5, f"{book[:3]}-{book[3:5]}-{book[5:9]}-{book[9:]}" if n & 4 else book, False
        yield 5, digits[:-1] + str((int(digits[-1]) + 1 + n % 9) % 10), False  # any other last digit fails
    else:
        inner = re.split("[^0-9]+", span[1:].strip())
        home = "0" + "".join(inner[1:]) if len(inner) > 1 else "0" + digits[2:]
        yield 5, ("00" + span[1:], f"({'0' + inner[1]}) {' '.join(inner[2:])}".strip() if len(inner) > 2 else home, home)[n % 3], True


def examples(text: str) -> Iterator[tuple[int, list[float], bool]]:
    """Kind, features and label of the proposals of a text and of its rewritten base matches."""
    matches = base_matches(text)
    for p in proposals(text):
        label = known(text, p, matches)
        if label is not None:
            yield p[1], features(text, p[0], p[2], p[1]), label
    for start, base, stop, ok in matches:
        if ok:
            before, after = text[max(0, start - 40) : start], text[stop : stop + 1]
            for kind, span, label in rewritten(text[start:stop], base):
                line, end = before + span + after, len(before) + len(span)
                # as a generator proposes it there, be it with a bracket or a neighbouring group
                for s, k, e in proposals(line):
                    if k == kind and s < end and e > len(before):
                        yield k, features(line, s, e, k), label


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, x (features), label of all examples of whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for value in batch.column(0).to_pylist() if value for e in examples(value)]
            kind, x, y = zip(*found) if found else ((), (), ())
            release()
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "x": pa.array(x, pa.list_(pa.float64())), "label": pa.array([float(v) for v in y], pa.float64())})

    bounded_batches()
    return docs.where(f"{text} is not null").select(text).mapInArrow(rows, "kind int, x array<double>, label double")


def calibrated(held: DataFrame, trees: Trees) -> Trees:
    """``trees`` with the least score of each kind from which they are right often enough on all rows of ``held`` (kind, x, label, n)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, WIDTH)
            steps = np.floor(trees.score(x) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(steps), batch.column("label"), batch.column("n")], ["kind", "step", "label", "n"])

    steps = held.select("kind", "x", "label", "n").mapInArrow(scan, "kind int, step int, label double, n long").groupBy("kind", "step")
    sums = steps.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).orderBy(F.desc("step")).toArrow()  # STEPS + 1 rows of a kind at most
    least, quality = {}, {}
    columns = [sums.column(c).to_numpy() for c in ("kind", "step", "n", "right")]
    for kind in range(BASE, len(KINDS)):
        step, n, right = (c[columns[0] == kind] for c in columns[1:])
        n, right = np.cumsum(n), np.cumsum(right)
        good = np.flatnonzero(right >= PRECISION * n) if len(n) and n[-1] >= LEAST_HELD and right[-1] else []
        if len(good):
            at = int(good[-1])
            below = step[at + 1] if at + 1 < len(step) else 0  # the next score that a held-out row has
            least[kind] = float(step[at] + below) / 2 / STEPS
            quality[KINDS[kind]] = (int(n[-1]), float(right[at] / n[at]), float(right[at] / right[-1]))
    return Trees(trees.trees, trees.weights, least, quality)


def fit(docs: DataFrame, text: str = "text") -> Trees:
    """Train on at most ``TRAIN_ROWS`` distinct labelled proposals, calibrate on all that are held out."""
    spark = docs.sparkSession
    path = scratch_path(spark, "proposals")
    labelled(docs, text).groupBy("kind", "x", "label").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    rows = spark.read.parquet(path)
    held = F.pmod(F.xxhash64("x"), F.lit(5)) == 4
    sample = by_hash(rows.where(~held), TRAIN_ROWS, "x", "label").toArrow()
    if len(set(sample.column("label").to_pylist())) < 2:
        return Trees([], [])
    train = spark.createDataFrame(sample).repartition(2).select(array_to_vector("x").alias("features"), "label", F.col("n").cast("double").alias("n"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, stepSize=0.3, weightCol="n").fit(train)
    return calibrated(rows.where(held), Trees(*_arrays(model)))


def find(texts: list[str | None], trees: Trees) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, stop) of each text, by start and kind."""
    out, rows, where = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        matches = base_matches(text)
        out.append([(s, k, e) for s, k, e, ok in matches if ok])
        if trees.trees:
            for s, k, e in proposals(text):
                if not _judged(text, (s, k, e), matches):  # what a base rule has judged stays as judged
                    rows.append(features(text, s, e, k))
                    where.append((i, (s, k, e)))
    if rows:
        for (i, span), score in zip(where, trees.score(np.array(rows))):
            if score >= trees.least.get(span[1], np.inf):
                out[i] = [*out[i], span]
    return [sorted(spans) for spans in out]


def spans(text: Column, trees: Trees) -> Column:
    """array<struct<start, kind_no, kind, stop>> of each text; code points, stop exclusive."""

    bounded_batches()

    @F.arrow_udf("array<struct<start: int, kind_no: int, kind: string, stop: int>>")
    def scan(texts: pa.Array) -> pa.Array:
        found = find(texts.to_pylist(), trees)
        release()
        kind = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())])
        return pa.array([[{"start": s, "kind_no": k, "kind": KINDS[k], "stop": e} for s, k, e in row] for row in found], pa.list_(kind))

    return scan(F.coalesce(text, F.lit("")))


def redact(text: Column, trees: Trees) -> Column:
    """Each text with its spans replaced by their kind in brackets; overlapping spans are replaced together."""

    bounded_batches()

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        out = []
        for value, found in zip(values, find(values, trees)):
            if found:
                parts, free = [], 0
                for start, kind, stop in found:
                    if start >= free:
                        parts += [value[free:start], f"[{KINDS[kind].upper()}]"]
                    free = max(free, stop)
                value = "".join(parts) + value[free:]
            out.append(value)
        release()
        return pa.array(out, pa.string())

    return clean(text)
