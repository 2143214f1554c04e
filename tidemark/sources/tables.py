"""Readers: parquet marts with a declared schema, or a live warehouse over JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark import schemas


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One mart; the schema is never inferred, so a day with odd files cannot change a type."""
    ddl, _, _ = schemas.TABLES[name]
    df = spark.read.schema(ddl).parquet(table_path(root, name))
    return df.select(*schemas.column_names(ddl))  # partition columns back in their place


def read_or_none(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """One mart, if anybody has written it."""
    try:
        return read_table(spark, root, name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_or_empty(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One mart, without rows as long as nobody has written it."""
    found = read_or_none(spark, root, name)
    return spark.createDataFrame([], schemas.TABLES[name][0]) if found is None else found


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    day_column: str | None = None,
    start: str | None = None,
    end: str | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """A warehouse table over JDBC, read in ``partitions`` day slices when a day range is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in options.items():
        reader = reader.option(key, value)
    if day_column and start and end:
        reader = (
            reader.option("partitionColumn", day_column)
            .option("lowerBound", start)
            .option("upperBound", end)
            .option("numPartitions", partitions)
        )
    return reader.load()


def run_sql(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """A parameterised statement over registered marts; values are bound, never spliced in."""
    return spark.sql(text, args=args) if args else spark.sql(text)


def register_views(marts) -> None:
    """Expose the given marts as temp views (``sessions``, ``daily``, ...) for SQL users."""
    for name, df in vars(marts).items():
        if df is not None:
            df.createOrReplaceTempView(name)
