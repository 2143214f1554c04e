"""Events -> one row per use session, and one per session and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.functions import event_fields as ef
from tidemark.functions.labels import mode_name
from tidemark.sources.writers import latest_by_key, on_days

# Event names of the log.
START, END = "pump_session_start", "pump_session_end"
ADJUST, USER = "pump_manual_adjust_evt", "pump_user_evt"

START_FIELDS = ["uid", "pump_device_id", "deviceCode", "os", "evtTimestamp_local", "local_hour", "is_weekday"]
END_FIELDS = [
    "evtTimestamp_local",
    "total_duration_sec",
    "finalModeType",
    "finalSuctionLevel",
    "endReason",
    "usedModeCount",
]
COUNTERS = [
    "mode_adj_cnt",
    "level_adj_cnt",
    "level_up_cnt",
    "level_down_cnt",
    "pause_cnt",
    "app_op_cnt",
    "manual_op_cnt",
]


def report_window(events: DataFrame, busi_date: str, late_days: int) -> DataFrame:
    """Events reported in the last ``late_days`` days, ``busi_date`` included."""
    last = F.lit(busi_date).cast("date")
    return events.where(F.col("dt").between(F.date_sub(last, late_days), last))


def build_sessions(events: DataFrame, busi_date: str | None = None, late_days: int = 7) -> DataFrame:
    """One row per (evt_dt, useSessionId) that has a start event.

    Two grouping steps, ``fold_hours`` and ``finish_sessions``. Repeated start or end events count
    once: the last by (evtTimestamp, id) wins, per event day for starts, as the table key demands.
    """
    if busi_date:
        events = report_window(events, busi_date, late_days)
    return finish_sessions(fold_hours(events))


def session_events(events: DataFrame) -> DataFrame:
    """The events that shape a session."""
    name = F.col("eventName")
    return events.where(
        (F.col("useSessionId") != "")  # neither null nor empty: an empty id names no session
        & (name.isin(START, END, ADJUST) | ((name == USER) & (F.col("evtType") == "pause")))
    )


def fold_hours(events: DataFrame) -> DataFrame:
    """One row per (useSessionId, evt_dt, hour).

    Most rows are folded map-side, and even a session id that a large part of all events carries is
    spread over its hours, so no task ever gathers it whole. A row depends on the events of its own
    event day only, which makes this the place to update when events arrive late.
    """
    rows = session_events(events)
    is_start = (F.col("eventName") == START) & F.col("evt_dt").isNotNull()
    is_end = F.col("eventName") == END
    is_adjust = F.col("eventName") == ADJUST
    is_mode = is_adjust & (F.col("evtType") == "pump_mode")
    is_level = is_adjust & (F.col("evtType") == "suction_level")
    order = F.struct("evtTimestamp", "id")
    step = F.concat(mode_name(F.col("adjustFrom")), F.lit("→"), mode_name(F.col("adjustTo")))

    return rows.groupBy(
        "useSessionId", "evt_dt", F.floor(F.col("evtTimestamp") / 3600000).alias("hour")
    ).agg(
        _last(is_start, order, START_FIELDS, with_day=True).alias("start"),
        _last(is_end, order, END_FIELDS).alias("end"),
        F.count_if(is_mode).alias("mode_adj_cnt"),
        F.sort_array(
            F.collect_list(
                F.when(is_mode & step.isNotNull(), F.struct("evtTimestamp", "id", step.alias("step")))
            )
        ).alias("steps"),
        F.count_if(is_level).alias("level_adj_cnt"),
        F.count_if(is_level & (F.col("adjust_direction") == "up")).alias("level_up_cnt"),
        F.count_if(is_level & (F.col("adjust_direction") == "down")).alias("level_down_cnt"),
        F.count_if((F.col("eventName") == USER) & (F.col("evtType") == "pause")).alias("pause_cnt"),
        F.count_if(is_adjust & (F.col("evtSource") == "remote_app")).alias("app_op_cnt"),
        F.count_if(is_adjust & (F.col("evtSource") == "manual")).alias("manual_op_cnt"),
    ).withColumn(
        # The hour's part of the path as one string: the second step then moves text, not lists.
        "path",
        F.when(F.size("steps") > 0, F.array_join(F.transform("steps", lambda s: s["step"]), ",")),
    ).select(*schemas.column_names(schemas.SESSION_HOURS))


def _last(test: Column, order: Column, fields: list[str], with_day: bool = False) -> Column:
    day = [F.col("evt_dt")] if with_day else []
    row = F.struct(order.alias("at"), *day, *[F.col(f) for f in fields])
    # An event without a time still has an id to order by.
    return F.max_by(F.when(test, row), F.when(test, order))


def finish_sessions(hours: DataFrame) -> DataFrame:
    """Join the few hour rows of each session into its session rows."""
    sessions = hours.groupBy("useSessionId").agg(
        F.collect_list("start").alias("starts"),
        F.max_by("end", F.col("end.at")).alias("e"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("hour", "path")))),
                lambda part: part["path"],
            ),
            ",",
        ).alias("path"),
        *[F.sum(c).alias(c) for c in COUNTERS],
    )
    rows = sessions.select("*", F.explode("starts").alias("s")).withColumn("evt_dt", F.col("s.evt_dt"))
    # The rows are already partitioned by session, so this adds a sort but no shuffle.
    rows = latest_by_key(rows, ["useSessionId", "evt_dt"], [F.col("s.at")])
    seconds = F.col("e.total_duration_sec")
    return rows.select(
        "evt_dt",
        "useSessionId",
        *[F.col(f"s.{c}").alias(c) for c in ["uid", "pump_device_id", "deviceCode", "os"]],
        F.col("s.evtTimestamp_local").alias("start_time"),
        F.col("e.evtTimestamp_local").alias("end_time"),
        F.col("s.local_hour").alias("local_hour"),
        F.col("s.is_weekday").alias("is_weekday"),
        seconds.alias("total_duration_sec"),
        F.round(seconds / 60, 2).try_cast("decimal(8,2)").alias("total_duration_min"),
        F.when(F.col("e").isNotNull(), 1).otherwise(0).alias("is_complete"),
        F.when(seconds > 600, 1).otherwise(0).alias("is_valid"),
        *[F.col(f"e.{c}").alias(c) for c in ["finalModeType", "finalSuctionLevel", "endReason", "usedModeCount"]],
        *COUNTERS,
        F.when(F.col("path") != "", F.col("path")).alias("mode_adj_path"),
    ).select(*schemas.column_names(schemas.SESSIONS))


def touched_days(events: DataFrame, busi_date: str, late_days: int) -> DataFrame:
    """Event days with a session event among those reported in the window."""
    window = session_events(report_window(events, busi_date, late_days))
    return window.where(F.col("evt_dt").isNotNull()).select("evt_dt").distinct()


def affected_start_days(hours: DataFrame, ids: DataFrame) -> DataFrame:
    """The days on which the given sessions started."""
    return _starts(hours).join(ids, "useSessionId", "left_semi").select("evt_dt").distinct()


def _starts(hours: DataFrame) -> DataFrame:
    day = F.col("start.evt_dt")
    return hours.where(day.isNotNull()).select("useSessionId", day.alias("evt_dt"))


def rebuild_start_days(hours: DataFrame, start_days: DataFrame) -> DataFrame:
    """All sessions that started on the given days.

    ``build_sessions`` sees only the report window, so overwriting an old day with its result would
    drop the rows that were reported earlier. Here whole days are rebuilt, from hour rows, which are
    about as few as sessions. A late end event completes its session wherever that started.
    """
    ids = _starts(hours).join(start_days, "evt_dt", "left_semi").select("useSessionId")
    sessions = finish_sessions(hours.join(ids, "useSessionId", "left_semi"))
    return sessions.join(start_days, "evt_dt", "left_semi").select(*sessions.columns)


def session_days(hours: DataFrame, buckets: int) -> DataFrame:
    """The index rows of hour rows: session id -> its days, hash-dealt by id, so that the days of some ids are found without the hours."""
    rows = hours.groupBy("evt_dt", "useSessionId").agg(F.bool_or(F.col("start.evt_dt").isNotNull()).alias("started"))
    return rows.withColumn("bucket", id_bucket(buckets)).select(*schemas.column_names(schemas.SESSION_DAYS))


def id_bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*(columns or ["useSessionId"])), F.lit(buckets)).cast("int")


def days_of(index: DataFrame, ids: DataFrame, buckets: int, started: bool = False) -> list:
    """The days of the given session ids, or those on which they start: calendar days. Only the ids' buckets are read."""
    return days_and_starts(index, ids, buckets)[started]


def days_and_starts(index: DataFrame, ids: DataFrame, buckets: int) -> tuple[list, list]:
    """The days of the given session ids and those on which they start, from one look at the index."""
    ids = ids.select("useSessionId", id_bucket(buckets).alias("bucket")).distinct()
    wanted = [r[0] for r in ids.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    rows = index.where(F.col("bucket").isin(wanted)).join(ids, ["bucket", "useSessionId"], "left_semi")
    found = rows.groupBy("evt_dt").agg(F.bool_or("started").alias("started")).collect()
    return [r.evt_dt for r in found], [r.evt_dt for r in found if r.started]


def rebuild_from_index(hours: DataFrame, index: DataFrame, starts: list, buckets: int) -> DataFrame:
    """``rebuild_start_days`` without a scan of all hours: the index names the days on which the sessions have any."""
    ids = on_days(index, starts).where("started").select("useSessionId").distinct()
    rows = on_days(hours, days_of(index, ids, buckets))
    sessions = finish_sessions(rows.join(ids, "useSessionId", "left_semi"))
    return on_days(sessions, starts)


def build_session_modes(events: DataFrame, busi_date: str | None = None, late_days: int = 7) -> DataFrame:
    """One row per (evt_dt, useSessionId, modeType) of the end events.

    The i-th mode goes with the i-th duration; what has no partner is dropped. A session without a
    start event is kept here although it has no row in ``sessions``.
    """
    if busi_date:
        events = report_window(events, busi_date, late_days)
    ends = events.where(
        (F.col("eventName") == END)
        & F.col("modeDuration").isNotNull()
        & F.col("evt_dt").isNotNull()
        & (F.col("useSessionId") != "")  # part of the table key
    )
    pairs = F.arrays_zip(
        ef.mode_types(F.col("modeDuration")).alias("mode"), ef.durations(F.col("modeDuration")).alias("sec")
    )
    rows = ends.select(
        "evt_dt",
        "useSessionId",
        "uid",
        "pump_device_id",
        "deviceCode",
        "evtTimestamp",
        "id",
        F.size(ef.durations(F.col("modeDuration"))).alias("_known"),
        F.posexplode(pairs).alias("_pos", "_pair"),
    ).where((F.col("_pos") < F.col("_known")) & F.col("_pair.mode").isNotNull())
    rows = rows.withColumn("modeType", F.col("_pair.mode")).withColumn("duration_sec", F.col("_pair.sec"))
    rows = latest_by_key(
        rows,
        ["evt_dt", "useSessionId", "modeType"],
        [F.col("evtTimestamp"), F.col("id"), F.col("_pos")],
    )
    return rows.withColumn(
        "duration_min", F.round(F.col("duration_sec") / 60, 2).try_cast("decimal(8,2)")
    ).select(*schemas.column_names(schemas.SESSION_MODES))
