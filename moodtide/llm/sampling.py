"""Bounded samples to fit models on."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """At most ``most`` rows: those with the least hashes of ``columns``, equal ones by the columns themselves.

    ``rows`` is stored or cheap: it is counted first, so that a share of the hashes little above what is needed
    can be cut off and the driver sees few more rows than it keeps, whatever the number of tasks.
    """
    total = rows.count()
    share = min(1.0, (most + 6 * sqrt(most) + 50) / max(1, total))
    hashed = rows.withColumn("_hash", F.xxhash64(*columns))
    near = hashed.where(F.pmod("_hash", F.lit(1 << 52)) < F.lit(int(share * (1 << 52)))) if share < 1 else hashed
    return near.orderBy(F.pmod("_hash", F.lit(1 << 52)), *columns).limit(most).drop("_hash")
