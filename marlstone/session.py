"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans partition counts and splits skewed join partitions at run time;
# the initial partition number is only an upper bound that AQE coalesces.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Adds and drops of a sync go to two folders at once instead of being sorted
    # by folder first, which keeps the files in chunk_id order.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # Pages can be large; small Arrow batches bound the memory of a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

# Removes the shuffle files of a query when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "marlstone", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session carrying the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Let a session that is not the library's own hand texts to Python in batches of the library's size.

    Every worker of an executor holds a batch of texts and one of results.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, DEFAULT_CONF[key])


def bound_batches(spark: SparkSession, most: str) -> None:
    """Let rows go to Python in batches of about ``most`` bytes (or one row), however many a task has."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's own, else a local one.

    A machine-local folder is only made up when no checkpoint folder is
    configured and the session runs in local mode.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return os.path.join(tempfile.gettempdir(), f"marlstone-{spark.sparkContext.applicationId}")


@contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files; else they stay until the JVM collects their objects."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before) if before else spark.conf.unset(_TIDY)


def keep(frame: DataFrame, path: str | None = None, tidy: bool = False, **options: str) -> DataFrame:
    """Write ``frame`` as a table in the shared folder and read it from there.

    For inputs that several branches of a plan use: they are worked out once,
    lineage ends at the files, and a lost executor costs no recomputation.
    With ``tidy`` the shuffle files behind the table go as soon as it is written.
    ``options`` are those of the Parquet writer.
    """
    spark = frame.sparkSession
    table = path or os.path.join(shared_dir(spark), f"kept-{os.urandom(8).hex()}")
    with _tidied(spark) if tidy else nullcontext():
        frame.write.options(**options).parquet(table)
    return spark.read.schema(frame.schema).parquet(table)


def buckets(spark: SparkSession) -> int:
    """How many buckets :func:`keep_by` deals rows into: as many as shuffles have partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_by(frames: Iterable[DataFrame], key: str, path: str | None = None, **options: str) -> DataFrame:
    """Write the rows of all ``frames``, one after the other, as one table in buckets of ``key``.

    Such tables join on ``key`` without a shuffle, and the shuffle files behind
    each frame go as soon as it is written. Rows of a bucket should lie in one
    partition of their frame, else every task writes a file for it. The table
    has a name in the session's catalog. What it is read for otherwise had better
    read its folder, ``path``: a scan by buckets has a task for each.
    """
    name = f"kept_{os.urandom(8).hex()}"
    for frame in frames:
        spark = frame.sparkSession
        with _tidied(spark):
            writer = frame.write.mode("append").format("parquet").options(**options).bucketBy(buckets(spark), key)
            writer.option("path", path or os.path.join(shared_dir(spark), name)).saveAsTable(name)
    return spark.table(name)
