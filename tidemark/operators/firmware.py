"""Firmware reports over the device table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.labels import STATUS_CODES, region_code, region_name, relabel, status_code
from tidemark.functions.measures import ratio

# Fixed value: length of the trend.
TREND_DAYS = 30


def with_version(devices: DataFrame) -> DataFrame:
    """Add ``version`` (NULL when the device reports none)."""
    version = F.get_json_object("device_info", "$.romVersion")
    return devices.withColumn("version", F.when(version != "null", version))


def apply_filter(
    devices: DataFrame, model: str | None = None, region: str | None = None, status: str | None = None
) -> DataFrame:
    """Optional filters; region and status accept a label or the stored code."""
    if model:
        devices = devices.where(F.col("model") == model)
    if region:
        devices = devices.where(F.col("data_source") == region_code(region))
    if status:
        devices = devices.where(F.col("status") == int(status_code(status)))
    return devices


def version_order(version: Column) -> list[Column]:
    """Numeric versions by value first, then all others by text."""
    number = version.try_cast("double")
    return [number.isNull(), number, version]


def version_trend(
    devices: DataFrame,
    as_of: str,
    model: str | None = None,
    region: str | None = None,
    status: str | None = None,
    days: int = TREND_DAYS,
) -> DataFrame:
    """Devices created per day and version in the last 30 days.

    The time filter comes first and is a plain comparison, so it reaches the scan; JSON is parsed for
    the remaining rows only.
    """
    since = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    rows = apply_filter(devices, model, region, status).where(F.col("create_time") >= since)
    rows = with_version(rows).where(F.col("version").isNotNull())
    counts = rows.groupBy(F.col("create_time").cast("date").alias("create_date"), "version").agg(
        F.count("*").alias("devices")
    )
    return counts.orderBy("create_date", "version")


def filter_options(devices: DataFrame) -> DataFrame:
    """All models, region labels, statuses and versions to choose from, in one long, ranked frame."""
    def option(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("option"), value.alias("value"))

    source = F.col("data_source")
    found = F.array(
        option("model", F.col("model")),
        option("region", F.when(source.isNotNull(), region_name(source))),
        option("version", F.col("version")),
    )
    fixed = F.array(*[option("status", F.lit(name)) for name in STATUS_CODES])
    # One scan for all lists; repeated values are dropped map-side.
    values = with_version(devices).select(F.explode(found).alias("o")).select("o.*").distinct()
    values = values.where(F.col("value").isNotNull()).unionByName(
        devices.sparkSession.range(1).select(F.explode(fixed).alias("o")).select("o.*")
    )
    is_version, value = F.col("option") == "version", F.col("value")
    number = F.when(is_version, value.try_cast("double"))
    order = [is_version & number.isNull(), number, value]
    rank = F.row_number().over(Window.partitionBy("option").orderBy(*order))
    return values.select("option", rank.alias("rank"), "value").orderBy("option", "rank")


def version_distribution(
    devices: DataFrame, status: str, model: str | None = None, region: str | None = None
) -> DataFrame:
    """Bound (or unbound) devices by version, largest first, with their share in percent."""
    rows = with_version(apply_filter(devices, model, region, status)).where(F.col("version").isNotNull())
    counts = rows.groupBy("version").agg(F.count("*").alias("devices"))
    total = F.sum("devices").over(Window.partitionBy())
    return counts.withColumn("pct", ratio(F.col("devices") * 100, total, 1)).orderBy(F.desc("devices"), "version")


def _shown(trend: DataFrame, as_of: str, days: int) -> tuple[Column, DataFrame]:
    """The dates shown, ascending, and one count per date and version.

    The last 30 days are shown, or everything when nothing falls into them; that and the dates are decided on all rows of the
    trend, also those without a version. Dates are no more than calendar days, so one value holds them.
    """
    since = F.date_sub(F.lit(as_of).cast("date"), days)
    known = trend.agg(F.sort_array(F.collect_set("create_date")).alias("known"))
    recent = F.filter("known", lambda d: d >= since)
    dates = known.select(F.when(F.size(recent) > 0, recent).otherwise(F.col("known"))).scalar()
    # Versions that differ in outer blanks only are the same; the last one counts.
    named = trend.where(F.col("version").isNotNull() & ~F.trim("version").isin("", "null"))
    counts = named.groupBy("create_date", F.trim("version").alias("version")).agg(F.max_by("devices", "version").alias("devices"))
    return dates, counts.where(F.array_contains(dates, F.col("create_date")))


def zero_filled(trend: DataFrame, as_of: str, days: int = TREND_DAYS) -> DataFrame:
    """Date x version matrix in long form, 0 where a version has no device on a day.

    Keeps the last 30 days, or everything when nothing falls into them. ``trend`` itself is the sparse form; it is read twice, for
    the dates and for the counts. The counts of a version, one per date at most, are gathered and spread over the dates, so
    versions, however many, stay rows and no join is needed. Rows without a date show nothing.
    """
    dates, counts = _shown(trend, as_of, days)
    lines = counts.groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct("create_date", "devices"))).alias("found"))
    cells = lines.select("version", "found", F.explode(dates).alias("create_date"))
    return cells.select("create_date", "version", F.coalesce(F.col("found")[F.col("create_date")], F.lit(0)).alias("devices")).orderBy(
        "create_date", *version_order(F.col("version"))
    )


def version_matrix(trend: DataFrame, as_of: str, versions: list[str], days: int = TREND_DAYS) -> DataFrame:
    """The same matrix with one column per version of ``versions``, in that order; one row per date shown.

    The list is the caller's, for example the rows of ``version_domain``, so no job runs to find it. Versions that are not
    in the list have no column but their dates keep their rows. A name may be listed once.
    """
    dates, counts = _shown(trend, as_of, days)
    days_shown = trend.sparkSession.range(1).select(F.explode(dates).alias("create_date"))
    blank = days_shown.select("create_date", F.lit(None).cast("string").alias("version"), F.lit(None).cast("long").alias("devices"))
    wide = counts.unionByName(blank).groupBy("create_date").pivot("version", versions).agg(F.sum("devices"))
    return wide.fillna(0, [f"`{v}`" for v in versions]).orderBy("create_date")


def device_details(
    devices: DataFrame,
    model: str | None = None,
    region: str | None = None,
    status: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """All devices with readable status and region, or the first ``rows`` of them by id.

    Only a page of ``rows`` is in order; a frame of all devices is not sorted as a whole, its reader sorts what it shows.
    """
    names = {code: label for label, code in STATUS_CODES.items()}
    found = apply_filter(devices, model, region, status)
    if rows is not None:
        found = found.orderBy("device_id").limit(rows)  # sort and cut first (a top-k), parse JSON for what remains
    return with_version(found).select(
        "device_name",
        F.right("device_id", F.lit(8)).alias("id_suffix"),
        "sn",
        "model",
        "type_id",
        "mac",
        "version",
        relabel(F.col("status"), names, F.col("status").cast("string")).alias("status"),
        *[F.col(c).cast("date").alias(c) for c in ("create_time", "update_time", "last_login")],
        region_name(F.col("data_source")).alias("region"),
    )


def version_domain(left: DataFrame, right: DataFrame) -> DataFrame:
    """Versions of either result, numeric order."""
    rows = left.select("version").union(right.select("version")).distinct()
    return rows.orderBy(*version_order(F.col("version")))
