import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moodtide.llm import arrays, langid, queries
from moodtide.plans.registry import QUERIES

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, DIR, "documents").collect()}
    rows = QUERIES["op7_language"](spark, DIR).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 200 < len(held) < 470
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_return_all_languages_of_a_trigram(spark):
    rows = [("abab abab", "x"), ("abab cdcd", "y"), ("cdcd cdcd", "z"), ("qqq", None), (None, "x")]
    filters = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.langs == ["x", "y", "z"]
    grams, _ = langid.trigrams(["bab dcd"])
    owners = [{lang for lang, bit in zip("xyz", row) if bit} for row in np.unpackbits(filters.masks(grams), axis=1, bitorder="little")[:, :3]]
    assert {"x", "y"} <= owners[1] and {"y", "z"} <= owners[4]
    assert filters.predict(["abab", "cdcd cdcd", "12 ?", None, ""])[0][:5] == ["x", "y", "und", "und", "und"]  # y and z own all of it


def test_awkward_rows(spark, awkward, nothing):
    filters = langid.fit(awkward.select("text", "lang"))
    out = {r.doc_id: r.p for r in awkward.select("doc_id", langid.predict(F.col("text"), filters).alias("p")).collect()}
    assert out[3].lang == "und" and out[4].lang == "und" and out[7].lang == "und" and out[7].score == 0
    assert out[8].lang == "pl"
    empty = langid.fit(nothing.select("text", "lang"))
    assert empty.langs == [] and awkward.select(langid.predict(F.col("text"), empty)["lang"].alias("l")).distinct().collect()[0].l == "und"


def test_many_languages_share_one_table(spark):
    rows = [(chr(ord("a") + i % 20) * 2 + chr(ord("a") + i // 2) + " " + chr(0x4E00 + i) * 3, f"l{i:02}") for i in range(30)]
    filters = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert filters.predict([t for t, _ in rows])[0] == [lang for _, lang in rows]


def test_a_batch_takes_little_memory_and_what_others_left_goes_first(monkeypatch):
    rng = np.random.default_rng(0)
    texts = pa.array(["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(1000)])
    filters = langid.Filters(["x", "y"], np.zeros((1 << 10, 1), np.uint8), np.zeros(2))
    langid._letters()
    events = []
    monkeypatch.setitem(arrays.KEPT, "another", lambda: events.append("forgotten"))
    seen = langid.Filters.predict
    monkeypatch.setattr(langid.Filters, "predict", lambda self, t: events.append("predicted") or seen(self, t))
    tracemalloc.start()
    assert len(langid.predict_batch(texts, filters)) == 1000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert events[0] == "forgotten" and events.count("predicted") == 9  # 2 MB in pieces of 250,000 bytes
    assert most < 60e6
