"""Tables as input: any DataFrame can stand in for a tree of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Fewer rows than this are not worth a task of their own.
TASK_ROWS = 64
# A scan with so many partitions for each core is never counted or dealt anew.
FULL = 16


def spread(frame: DataFrame) -> DataFrame:
    """``frame``, dealt over the cores if its rows lie in fewer partitions than there are cores.

    A scan deals bytes, but a Parquet row group is read by one task: a table of
    one row group leaves all but one core idle, whatever its partition number
    says. Rows are counted by partition, without reading a column; only if too
    few partitions have any, they are shuffled. Tables that fill the cores are
    left as they are: nothing is shuffled, and large ones are not even counted.
    """
    context = frame.sparkSession.sparkContext
    cores = context.defaultParallelism
    if frame.rdd.getNumPartitions() >= FULL * cores:
        return frame
    filled = frame.groupBy(F.spark_partition_id().alias("part")).count().agg(F.count("*"), F.sum("count")).first()
    wanted = min(cores, -(-(filled[1] or 0) // TASK_ROWS))
    return frame.repartition(wanted) if wanted > filled[0] else frame


def read_table(spark: SparkSession, folder: str, name: str, dealt: bool = True) -> DataFrame:
    """A table of a folder, :func:`spread` unless ``dealt`` is False."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(table) if dealt else table


def as_files(
    table: DataFrame,
    rel_path: Column,
    content: Column,
    source_name: str = "",
    url_base: str = "",
    source_url_base: str | None = None,
    prefix_source_path: bool = False,
) -> DataFrame:
    """Rows of a table in the shape the page parser reads."""
    return table.select(
        F.lit(source_name).alias("source_name"),
        rel_path.alias("rel_path"),
        content.cast("binary").alias("content"),
        F.lit(url_base).alias("url_base"),
        F.lit(source_url_base).cast("string").alias("source_url_base"),
        F.lit(prefix_source_path).alias("prefix_source_path"),
    )
