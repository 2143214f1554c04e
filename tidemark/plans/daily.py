"""Sessions + power-on events -> one row per day and device model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas
from tidemark.functions.measures import ratio
from tidemark.plans.sessions import report_window

# Fixed value: event name of the log.
POWER_ON = "pump_startup_evt"


def first_days(sessions: DataFrame) -> DataFrame:
    """First day of every user, device and session with every model, and the seconds of every day: (kind, id, deviceCode, of, day, seconds).

    One scan and one shuffle for all; rows are folded map-side first. Rows of seconds have their day as ``of`` and no id; session
    ids may recur on another day but hardly ever do.
    """
    def entry(kind: str, id_: Column, of: Column | None = None, seconds: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("kind"),
            id_.cast("string").alias("id"),
            (none if of is None else of).cast("date").alias("of"),
            (none if seconds is None else seconds).cast("bigint").alias("seconds"),
        )

    entries = F.array(
        entry("user", F.col("uid")),
        entry("device", F.col("pump_device_id")),
        entry("session", F.col("useSessionId")),
        entry("seconds", F.lit(None), F.col("evt_dt"), F.col("total_duration_sec")),
    )
    rows = sessions.select("evt_dt", "deviceCode", F.explode(entries).alias("e")).select("evt_dt", "deviceCode", "e.*")
    rows = rows.where(F.col("id").isNotNull() | F.col("kind").isin("session", "seconds"))
    return rows.groupBy("kind", "id", "deviceCode", "of").agg(F.min("evt_dt").alias("day"), F.sum("seconds").alias("seconds"))


def cumulative(sessions: DataFrame) -> DataFrame:
    """Per (day, model): new ids, and running totals since the first day.

    The distinct count up to a day is the running sum of first appearances, so history is reduced to
    one small row per (day, model) before any window runs. The row of an unknown (NULL) model counts over all models.
    """
    return running_totals(increments(sessions))


def increments(sessions: DataFrame) -> DataFrame:
    """Per (day, model): the ids first seen there and the seconds, from all sessions.

    ``model_*`` counts an id on its first day with the model, ``new_*`` on each model it used on its very first day; ``any_*`` counts
    each id exactly once over all models, on its first day.
    """
    per_id = Window.partitionBy("kind", "id", "of")  # at most one row per model
    rows = first_days(sessions).withColumns(
        {
            "is_new": F.col("day") == F.min("day").over(per_id),
            "is_one": F.row_number().over(per_id.orderBy("day", "deviceCode")) == 1,
        }
    )
    counts = []
    for kind in ("user", "device", "session"):
        this = F.col("kind") == kind
        counts += [
            F.count_if(this).alias(f"model_{kind}s"),
            F.count_if(this & F.col("is_new")).alias(f"new_{kind}s"),
            F.count_if(this & F.col("is_one")).alias(f"any_{kind}s"),
        ]
    rows = rows.groupBy(F.col("day").alias("evt_dt"), "deviceCode").agg(*counts, F.sum("seconds").alias("seconds"))
    return rows.drop("new_sessions")


def running_totals(ledger: DataFrame) -> DataFrame:
    own = Window.partitionBy("deviceCode").orderBy("evt_dt").rowsBetween(Window.unboundedPreceding, 0)
    # Days x models rows: a few thousand at most, so one partition is enough for the overall total.
    overall = Window.partitionBy().orderBy("evt_dt").rangeBetween(Window.unboundedPreceding, 0)

    def running(model: str, any_: str) -> Column:
        return F.when(F.col("deviceCode").isNull(), F.sum(any_).over(overall)).otherwise(F.sum(model).over(own))

    return ledger.select(
        "evt_dt",
        "deviceCode",
        "new_users",
        "new_devices",
        running("model_users", "any_users").alias("cumulative_users"),
        running("model_devices", "any_devices").alias("cumulative_devices"),
        running("model_sessions", "any_sessions").alias("cumulative_sessions"),
        running("seconds", "seconds").alias("cumulative_sec"),
    )


def activity(sessions: DataFrame) -> DataFrame:
    """Per (day, model): users, devices and session totals.

    Sessions are first folded to (day, model, user, device), which shrinks the input of the two
    distinct counts. A day holds each session id once, so counting rows counts sessions.
    """
    folded = sessions.groupBy("evt_dt", "deviceCode", "uid", "pump_device_id").agg(
        F.count("useSessionId").alias("sessions"),
        F.sum("is_complete").alias("complete"),
        F.sum("is_valid").alias("valid"),
        F.sum("total_duration_sec").alias("seconds"),
    )
    return folded.groupBy("evt_dt", "deviceCode").agg(
        F.countDistinct("uid").alias("dau"),
        F.countDistinct("pump_device_id").alias("active_devices"),
        F.sum("sessions").alias("total_sessions"),
        F.sum("complete").alias("complete_sessions"),
        F.sum("valid").alias("valid_sessions"),
        F.sum("seconds").alias("total_duration_sec"),
    )


def power_on_counts(events: DataFrame, by_model: bool = False) -> DataFrame:
    keys = ["evt_dt", "deviceCode"] if by_model else ["evt_dt"]
    return (
        events.where((F.col("eventName") == POWER_ON) & F.col("evt_dt").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("power_on_cnt"))
    )


def build_daily(
    sessions: DataFrame,
    events: DataFrame,
    busi_date: str | None = None,
    late_days: int = 7,
    power_on_by_model: bool = False,
    full_days_from: str | None = None,
) -> DataFrame:
    """The daily table for the window's days (all days when ``busi_date`` is not given).

    ``full_days_from`` recomputes every day from that one on, and counts power-ons of any report day.

    As in the published job, the power-on count of a day is repeated on each of its model rows;
    ``power_on_by_model=True`` counts per model instead.
    """
    recent = sessions
    if busi_date:
        last = F.lit(busi_date).cast("date")
        if full_days_from:
            first = F.lit(full_days_from).cast("date")
            events = events.where((F.col("dt") <= last) & (F.col("evt_dt") >= first))
        else:
            first = F.date_sub(last, late_days)
            events = report_window(events, busi_date, late_days)
        recent = sessions.where(F.col("evt_dt").between(first, last))
        # Days after the last reported one do not change any total up to it.
        sessions = sessions.where(F.col("evt_dt") <= last)

    return daily_rows(activity(recent), cumulative(sessions), power_on_counts(events, power_on_by_model), power_on_by_model)


def daily_rows(counts: DataFrame, totals: DataFrame, power_ons: DataFrame, power_on_by_model: bool = False) -> DataFrame:
    """The daily table of the (day, model) rows of ``counts``, with their running totals and power-ons."""
    # Three small frames of one row per (day, model) are stacked and folded: unlike a join this takes
    # an unknown (NULL) model as a value of its own.
    frames = [counts, totals, power_ons]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    keys = ["evt_dt", "deviceCode"]
    rows = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in keys])
    power = F.col("power_on_cnt")
    if not power_on_by_model:
        power = F.max(power).over(Window.partitionBy("evt_dt"))
    rows = rows.withColumn("power_on_cnt", F.coalesce(power, F.lit(0))).where(F.col("total_sessions").isNotNull())

    sessions_, users, seconds = F.col("total_sessions"), F.col("dau"), F.col("total_duration_sec")
    rows = rows.withColumns(
        {
            "avg_sessions_per_user": ratio(sessions_, users, 2),
            "total_duration_h": ratio(seconds, F.lit(3600), 2),
            "avg_duration_min": ratio(seconds, sessions_ * 60, 2),
            "avg_duration_per_user": ratio(seconds, users * 60, 2),
            "start_rate": ratio(sessions_, F.col("power_on_cnt"), 5),
            "completion_rate": ratio(F.col("complete_sessions"), sessions_, 5),
            "valid_rate": ratio(F.col("valid_sessions"), sessions_, 5),
            "cumulative_duration_h": ratio(F.col("cumulative_sec"), F.lit(3600), 2),
        }
    )
    return as_table(rows, schemas.DAILY)


def as_table(rows: DataFrame, ddl: str) -> DataFrame:
    """Columns in table order and type; a value too large for its column becomes NULL."""
    types = dict(zip(schemas.column_names(ddl), schemas.column_types(ddl)))
    return rows.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in types.items()])
