"""Scoring of texts as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from moodtide.operators.learn import classify_label


def read_text_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files below ``path`` as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def stream_score(
    texts: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score every arriving text and append its sentiment and percentage to ``out``.

    ``score`` adds ``probability`` and may be any batch transform. A micro-batch that is run again
    after a failure overwrites its own folder, so each text appears once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        classify_label(score(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_classify(texts: DataFrame, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Label every arriving text by a row-local transform and append it to ``out``.

    Nothing is shuffled and nothing waits: the file sink itself writes each text exactly once.
    """
    labelled = classify_label(classify(texts))
    sink = labelled.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()
