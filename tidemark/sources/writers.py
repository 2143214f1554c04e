"""Writers: later-row-wins on the table key, and overwrite of touched days only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import schemas
from tidemark.session import bound_shuffles, bound_splits
from tidemark.sources.tables import read_or_none, table_path

# Rows of keys and places, of which a shuffle partition takes so many times as many as of wide ones.
NARROW = 5
# Rows whose places are one bitmap: as many as bitmap_construct_agg has bits.
SPAN = 32_768
# Bitmaps, 4 KB each, up to which a merge sends them to all tasks whatever size Spark would send: 64 MB.
SENT_SPANS = 16_384
# Rows of a key above which it was once merged on its own; now every key is cut to one row per map task.
MANY_ROWS = 10_000


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last one in ``order``.

    ``row_number() == 1`` lets Spark put a WindowGroupLimit before the shuffle, so a key that holds
    a large part of the rows is cut to one row per map task first.
    """
    newest_first = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest_first)).where("_rank = 1").drop("_rank")


def frequent_keys(rows: DataFrame, keys: list[str], more_than: int, path: str) -> DataFrame:
    """Keys of more than so many rows: counted on the key columns alone, written and read back, so that a join knows how few they are."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).drop("_n")
    counted.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(counted.schema).parquet(path)


def with_keys(rows: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of the given keys, or all others if ``how`` is left_anti; a missing value is a value."""
    named = wanted.toDF(*[f"_{c}" for c in wanted.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in wanted.columns]
    return rows.join(named, reduce(Column.__and__, same), how)


def write_days(df: DataFrame, root: str, name: str, mode: str = "dynamic", dealt: bool = False) -> str:
    """Overwrite the partitions that occur in ``df`` and leave all others as they are (all go if ``mode`` is static).

    REBALANCE gathers each day into right-sized files and splits a day that is far larger than the
    others, which a plain repartition by day would send to one task. Rows that are ``dealt`` by day already are written by the
    tasks that hold them.
    """
    ddl, partitions, _ = schemas.TABLES[name]
    path = table_path(root, name)
    df = df.select(*schemas.column_names(ddl))
    if partitions and not dealt:
        df = df.hint("rebalance", *partitions)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return path


def write_report_day(df: DataFrame, root: str, name: str, report_day: str) -> str:
    """Replace all rows of one report day of a table partitioned by (report day, event day).

    The folder of the report day is overwritten as a whole, so rows that a corrected log no longer has go too.
    """
    ddl, (report, event), _ = schemas.TABLES[name]
    path = f"{table_path(root, name)}/{report}={report_day}"
    df = df.select(*schemas.column_names(ddl)).drop(report).hint("rebalance", event)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(event).parquet(path)
    return path


def replace_days(df: DataFrame, root: str, name: str, days: list, run: str = "", dealt: bool = False) -> str:
    """Overwrite the given values of the first partition column, also those for which ``df`` has no rows any more.

    The rows are written to a staging folder first, one per ``run``, as the table may be among the sources of ``df``.
    """
    stage(df, root, name, run, dealt)
    path = publish(df.sparkSession, root, name, days, run)
    clear_stage(df.sparkSession, root, name, run)
    return path


def clear_stage(spark: SparkSession, root: str, name: str, run: str = "") -> None:
    """Remove the staging folder of a table whose rows are in place."""
    _remove(spark, table_path(_staging(root, run), name))


def upsert(df: DataFrame, root: str, name: str, order: list[Column], run: str = "", dealt: bool = False) -> str:
    """Merge rows into a stored table: of the stored and the new rows of a key, the last one in ``order`` stays.

    A late copy of an old row thus never replaces a newer stored one; of rows equal in ``order`` the new one wins. Nothing is
    deleted but replaced rows. Only the partitions that ``df`` touches are read and written, so the first partition column
    must belong to the key. Which rows stay is decided on keys, order and the place of a row in its file; a key that is met very often is cut to
    one row per map task first. The places come back as a bit per row, by which wide rows are taken from their files. Where the
    partitions of ``df`` hold few days each (``dealt``), wide rows are not moved at all; else one shuffle gathers those that stay by day.
    The merge may be repeated after a stop: it gives the same rows.
    """
    ddl, columns, keys = schemas.TABLES[name]
    if not columns or columns[0] not in keys:
        raise ValueError(f"rows of {name} cannot be merged: a key may lie in any partition")
    names = schemas.column_names(ddl)
    spark, day, top = df.sparkSession, columns[0], _staging(root, run)
    bound_splits(spark)
    writer = df.select(*names).write.mode("overwrite").option("compression", "zstd")
    if dealt:
        writer = writer.partitionBy(*columns)
    writer.parquet(f"{top}/{name}_new")
    fresh = spark.read.schema(ddl).parquet(f"{top}/{name}_new")
    touched = [r[0] for r in fresh.select(day).distinct().collect()]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows, stored = fresh.select(*names, F.lit(True).alias("_new"), *place), read_or_none(spark, root, name)
    if stored is not None:
        stored = on_days(stored, touched, day).select(*names, F.lit(False).alias("_new"), *place)
        rows, stored = rows.unionByName(stored), None if stored.isEmpty() else stored

    found = rows.count()
    bound_shuffles(spark, -(-found // NARROW))
    order = {f"_order{n}": c for n, c in enumerate([*order, F.col("_new"), F.xxhash64(*names)])}
    narrow = rows.select(*keys, *[c.alias(n) for n, c in order.items()], "_file", "_row")
    stay = _places(latest_by_key(narrow, keys, [F.col(n) for n in order]), f"{top}/{name}_stay")
    spans, staying = stay.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if dealt and stored is None and staying == found:  # nothing to merge: the files are the table's
        path = publish(spark, root, name, touched, run, f"{name}_new")
    else:
        stay = F.broadcast(stay) if spans <= SENT_SPANS else stay
        path = replace_days(_at_places(rows, stay).select(*names), root, name, touched, run, dealt)
    for folder in (f"{name}_new", f"{name}_stay"):
        _remove(spark, f"{top}/{folder}")
    return path


def _places(rows: DataFrame, path: str) -> DataFrame:
    """The places (_file, _row) of rows as a bitmap for each 32,768 rows of a file, written and read back, so that a join knows how small they are."""
    places = rows.groupBy("_file", F.expr(f"_row div {SPAN}").alias("_span")).agg(
        F.bitmap_construct_agg(F.col("_row") % SPAN).alias("bits"), F.count("*").alias("rows")
    )
    places.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(places.schema).parquet(path)


def _at_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows that stand at the given places."""
    rows = rows.withColumn("_span", F.expr(f"_row div {SPAN}")).join(places, ["_file", "_span"]).drop("rows")
    byte = f"cast(conv(hex(substring(bits, cast(_row % {SPAN} div 8 + 1 as int), 1)), 16, 10) as int)"
    return rows.where(f"getbit({byte}, cast(_row % 8 as int)) = 1")


def _staging(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/_staging{run and '/' + run}"


def stage(df: DataFrame, root: str, name: str, run: str = "", dealt: bool = False) -> DataFrame:
    """The rows, written and read back from the staging folder of the run."""
    path = write_days(df, _staging(root, run), name, "static", dealt)
    return df.sparkSession.read.schema(schemas.TABLES[name][0]).parquet(path)


def publish(spark: SparkSession, root: str, name: str, days: list, run: str = "", folder: str = "") -> str:
    """Put staged rows in place: the folders of their partitions become those of the table, other partitions of the given days go.

    Nothing is read or written again. It may be repeated after a stop, when the rows have been staged once more.
    """
    columns = schemas.TABLES[name][1]
    path, staged = table_path(root, name), f"{_staging(root, run)}/{folder or name}"
    fs, table = _at(spark, path)
    fs.mkdirs(table)
    found = _partitions(spark, staged, len(columns))
    wanted = {_folder(spark, columns[0], day) for day in days}
    for gone in sorted(_partitions(spark, path, len(columns), wanted) - found):
        _remove(spark, f"{path}/{gone}")
    for part in sorted(found):
        _remove(spark, f"{path}/{part}")
        (_, old), (_, new) = _at(spark, f"{staged}/{part}"), _at(spark, f"{path}/{part}")
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"{staged}/{part} cannot be put in place")
    return path


def clear_run(spark: SparkSession, root: str, name: str, run: str) -> None:
    """Take a finished run out of a table of runs."""
    _, (column,), _ = schemas.TABLES[name]
    _remove(spark, f"{table_path(root, name)}/{_folder(spark, column, run)}")


def _at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _folder(spark: SparkSession, column: str, value) -> str:
    """The folder of a partition, as Spark names it."""
    if value is None or value == "":
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))}"


def _partitions(spark: SparkSession, path: str, depth: int, first: set[str] | None = None) -> set[str]:
    """The partition folders so many levels below a path; only those in the folders ``first`` of the first level, if given."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return set()
    names = {s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()}
    names = {n for n in names if "=" in n and (first is None or n in first)}
    return names if depth == 1 else {f"{n}/{below}" for n in names for below in _partitions(spark, f"{path}/{n}", depth - 1)}


def on_days(df: DataFrame, days: list, column: str = "evt_dt") -> DataFrame:
    """Rows of the given days, None among them for rows without one; a plain list prunes partitions."""
    known = F.col(column).isin([d for d in days if d is not None])
    return df.where(known | F.col(column).isNull() if None in days else known)


def write_frames(frames: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each frame of a section to its own folder; returns name -> path."""
    paths = {}
    for name, df in frames.items():
        paths[name] = table_path(root, name)
        df.write.mode("overwrite").format(fmt).save(paths[name])
    return paths
