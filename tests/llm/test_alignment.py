import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodtide.llm import alignment, queries
from moodtide.plans.registry import QUERIES

FILES = [open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
A = Tokenizer.from_str(FILES[0].decode())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=FILES[1])
LETTERS = alignment.byte_alphabet()


def links_of(text):
    """Ids of both sides, groups and links of one text, token by token; None where a side does not spell it back."""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    spelled_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    spelled_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not text or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
        return None
    groups, left, right, ends = [], [], [], [0, 0]
    a_queue, b_queue = list(zip(a, spelled_a)), list(zip(b, spelled_b))
    while a_queue or b_queue:
        side = 0 if ends[0] <= ends[1] and a_queue else 1
        token, spelled = (a_queue, b_queue)[side].pop(0)
        (left, right)[side].append(token)
        ends[side] += len(spelled)
        if ends[0] == ends[1]:
            groups.append((left, right))
            left, right = [], []
    return a, b, groups, Counter((x, y) for g, h in groups for x in g for y in h)


def plain(docs):
    """All measures by listing every link of every document."""
    found = [(doc_id, links_of(text) if text else None) for doc_id, text in docs]
    counts = Counter(pair for _, f in found if f for pair in f[3])
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for doc_id, f in found:
        if not f:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for (x, y), n in links.items() if counts[x, y] == most[x])
        total = sum(n * counts[pair] for pair, n in links.items())
        rows.append((doc_id, len(a), len(b), len(groups), links.total(), best, total, hashlib.sha256(written.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet=" ab\n▁é日😀'1", max_size=30)), min_size=1, max_size=4))
def test_alignment_of_any_texts(texts):
    measures, written, edges, codes, times = alignment.Aligner.of(*FILES).align(texts)
    for i, text in enumerate(texts):
        expected = links_of(text)
        pairs = Counter({divmod(c, B.get_piece_size()): n for c, n in zip(codes[edges[i] : edges[i + 1]].tolist(), times[edges[i] : edges[i + 1]].tolist())})
        if expected is None:
            assert (measures["n_a"][i], measures["n_groups"][i], measures["n_links"][i], written[i], len(pairs)) == (0, 0, 0, b"", 0)
            continue
        a, b, groups, links = expected
        assert (measures["n_a"][i], measures["n_b"][i], measures["n_groups"][i], measures["n_links"][i]) == (len(a), len(b), len(groups), links.total())
        assert written[i].decode() == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        assert pairs == links


def test_large_groups_count_equal_ids_first(monkeypatch):
    texts = ["Grüße, 日本語 😀😀 straße", "plain words here", "😀日"]
    whole = alignment.Aligner.of(*FILES).align(texts)
    monkeypatch.setattr(alignment, "_LISTED", 1)
    for x, y in zip(whole[2:], alignment.Aligner.of(*FILES).align(texts)[2:]):
        assert x.tolist() == y.tolist()


def test_awkward_rows(spark, awkward, nothing):
    given = awkward.withColumns({"n_a": F.lit("clash"), "pair": F.lit(1), "text_hash": F.lit(2)})
    assert rows_of(alignment.measures(given, *FILES, ["doc_id"])) == plain([(r.doc_id, r.text) for r in awkward.collect()])
    assert rows_of(alignment.measures(nothing, *FILES, ["doc_id"])) == []


@pytest.mark.parametrize("common", [0, 40, 1 << 20])
def test_pairs_beyond_the_broadcast_are_joined(spark, monkeypatch, common):
    monkeypatch.setattr(alignment, "COMMON", common)
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the cat", "a cat sat on the mat", "the cat", None, "a▁b", "", "  twice  "] * 3)]
    found = alignment.measures(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), *FILES, ["doc_id"], keep_groups=True)
    rows = found.collect()
    assert rows_of(found) == plain(docs)
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert rows_of(QUERIES["op12_alignment"](spark, sf)) == plain(docs)
