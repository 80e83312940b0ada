"""What queries load instead of making it: lexicons and models, stored once for a data folder and session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from moodtide.operators import learn, lexicon
from moodtide.plans import fixtures as fx
from moodtide.session import scratch_path
from moodtide.sources import readers

_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, store: Callable[[str], None]) -> str:
    """The path below the shared folder that ``store`` has written, in this session or just now."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        store(path)
        _STORED[key] = path
    return _STORED[key]


def merged_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The learned lexicon with the small one over it, as a stored table."""

    def store(path: str) -> None:
        lexicon.merge_lexicon(fx.learned_lexicon(spark, sf), fx.lexicon(spark)).write.options(header=True).csv(path)

    return readers.load_lexicon(spark, stored(spark, sf, "merged-lexicon", store))


def word_classifier(spark: SparkSession, sf: str) -> PipelineModel:
    """The classifier of the flows, trained on the labelled documents, stored and loaded."""
    path = stored(spark, sf, "word-classifier", lambda p: learn.save_classifier(learn.train_word_classifier(fx.labelled(spark, sf)), p))
    return learn.load_classifier(path)
