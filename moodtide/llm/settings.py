"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch; a Python worker holds a batch several times over (texts, tokens, results).
BATCH_BYTES = "4m"
_KEY, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches() -> None:
    """Let the active session's Arrow batches hold ``BATCH_BYTES`` at most, unless it names a bound of its own.

    Results do not depend on it; one longer text is a batch of its own.
    """
    spark = SparkSession.active()
    if spark.conf.get(_KEY) == f"{_DEFAULT}b":
        spark.conf.set(_KEY, BATCH_BYTES)
