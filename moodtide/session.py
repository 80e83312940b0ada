"""Session set-up, scratch locations and the two scale guards shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest table, in rows, that is ever sent to every executor.
BROADCAST_ROWS = 250_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "moodtide") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MOODTIDE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder. A cluster session
    without it is an error, since a machine-local folder would not survive there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="moodtide-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared root that nothing else uses."""
    return f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that several readers share one computation."""
    shared_root(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the frames that are made inside go when an action on them ends.

    Else they stay until the driver happens to collect its garbage, and a long job keeps those of all its steps.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores out to all cores, by ``keys``.

    A scan of many splits, which is every big one, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows.

    Above the bound the frame is returned as it is: the join then shuffles and adaptive
    execution splits skewed keys. The check counts rows up to the bound, so a frame that is dear
    to compute is materialised before.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_global_position(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the total order given by ``order``.

    A range sort spreads the rows, each partition numbers its own, and only one count per
    partition meets in a single task. The sorted rows are checkpointed because both the counts
    and the result read them, and a second sort might cut the ranges elsewhere.
    """
    low = (1 << 33) - 1  # monotonically_increasing_id keeps the partition above 33 bits
    placed = materialise(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_mid", 33)
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")  # one row per sort partition
        .withColumn(out, F.col("_start") + F.col("_mid").bitwiseAND(F.lit(low)))
        .drop("_mid", "_part", "_start")
    )
