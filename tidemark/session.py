"""Session settings the jobs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Recording the Python call site of every Column doubles the time to build a wide plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def bound_splits(spark: SparkSession, size: str = "16m") -> None:
    """Tasks read files in pieces of so many bytes: event rows take some thirty times as much in memory, where a task sorts them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


# Rows of a shuffle partition before Spark merges small ones: a group-by of rows with structs sorts its partition in memory.
ROWS_A_PARTITION = 100_000


def bound_shuffles(spark: SparkSession, rows: int) -> None:
    """Shuffles of so many rows get the partitions these need, if the session has fewer; a set number of them would grow with the rows."""
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    needed = -(-rows // ROWS_A_PARTITION)
    for name in names:
        if int(spark.conf.get(name, None) or needed) < needed:
            spark.conf.set(name, needed)


def build_session(app_name: str = "tidemark", master: str | None = None, **overrides) -> SparkSession:
    """A session with the settings above; ``overrides`` win (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
