import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import queries, spelling
from moodtide.plans.registry import QUERIES


def edits(a, b):
    """Whether exactly one inserted, deleted or replaced code point separates two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    """Every two words compared."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(w, v)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return sorted(rows)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_filters_miss_nothing_and_seldom_err():
    hashed = np.random.default_rng(1).integers(0, 2**63, 40_000, dtype=np.uint64)
    bits = spelling.build(hashed[:20_000])
    filters = spelling.Filters({(9, 0): bits}, {9: 1}, {9: np.zeros(0, np.uint32)})
    assert filters.probe(9, hashed[:20_000]).all()
    assert filters.probe(9, hashed[20_000:]).mean() < 0.01


def test_hashes_of_edits_are_those_of_the_edited_words():
    words = ["aabbcd", "zzzzzz", "abcéfg"]
    everything = spelling.Filters({}, {5: 1, 6: 1}, {5: np.array([97], np.uint32), 6: np.array([ord("x"), ord("é")], np.uint32)})
    asked = []
    everything.probe = lambda of, hashed: asked.append((of, hashed)) or np.ones(len(hashed), bool)
    (_, codes), = spelling.by_length(words)
    found = [e for _, edited in everything.candidates(codes) for e in edited]
    expected = np.concatenate([spelling.hashes(c)[np.argsort(at)] if len(at) == 1 else spelling.hashes(c) for w in found for at, c in spelling.by_length([w])])
    assert (np.concatenate([h for _, h in asked]) == expected).all()
    assert found.count("abbcd") == 1 and found.count("zzzzz") == 1


@pytest.mark.parametrize("part, held", [(1 << 18, 64 << 20), (16, 200)])
def test_groups_equal_every_two_words_compared(spark, monkeypatch, part, held):
    monkeypatch.setattr(spelling, "PART_WORDS", part)
    monkeypatch.setattr(spelling, "PASS_BYTES", held)
    rng = random.Random(4)
    counts = Counter()
    for _ in range(150):
        word = "".join(rng.choice("abß") for _ in range(rng.randint(1, 9)))
        counts[word] += rng.choice([2, 30, 400, 5000])
    long = "abcdefghij" * 3000
    counts.update({long: 500, long[:-1]: 40, long[:700] + "x" + long[701:]: 7, long[:64]: 3, long[:63]: 50})
    given = [(w, n - 1) for w, n in counts.items()] + [(w, 1) for w in counts] + [(None, 5)]
    words = spark.createDataFrame(given, "word string, n long").repartition(5)
    assert rows_of(spelling.group(words)) == plain(counts)


def test_words_are_counted_whole(spark):
    words = spark.createDataFrame([("abcdefg",), ("abcdefg",), ("abcdef",), ("abcdef",), ("once_more",), (None,)], "word string")
    assert [(r.word, r.n) for r in spelling.vocabulary(words).collect()] == [("abcdefg", 2)]
    text = spark.createDataFrame([("Ünder ÄRGER×naïve 7a-B Z",), (None,)], "text string")
    assert [r[0] for r in text.select(spelling.runs(F.col("text"))).collect()] == [["Ünder", "Ärger×naïve", "a", "b", "z"], None]


def by_contract(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    more = [(20 + i, "commonest " * 3 + ("commonezt" if i % 9 == 0 else "")) for i in range(60)] + [(None, "commonest Commonest")] * 2
    docs = awkward.withColumns({"word": F.lit("clash"), "n": F.lit(1), "run": F.lit(2)})
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    expected = plain(by_contract([(r.doc_id, r.text) for r in docs.collect()]))
    assert rows_of(QUERIES["op11_spelling"](spark, str(tmp_path))) == expected and len(expected) > 1
    nothing.write.mode("overwrite").parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert QUERIES["op11_spelling"](spark, str(tmp_path / "empty")).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert rows_of(QUERIES["op11_spelling"](spark, sf)) == plain(by_contract(docs))
