"""Series with one row per day. All read the small daily (or retention) table, except T14-T16."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.buckets import SESSIONS_PER_DAY_SHORT, bucket_label
from tidemark.functions.measures import ratio, weighted_mean, with_share
from tidemark.marts import Marts, in_range
from tidemark.operators.kpi import ALL, sessions_per_user_day


def _by_day(marts: Marts, start: str, end: str, device_code: str | None, *columns: Column) -> DataFrame:
    rows = in_range(marts.daily, start, end, device_code).groupBy(F.col("evt_dt").alias("dt"))
    return rows.agg(*columns).orderBy("dt")


def active_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    return _by_day(
        marts, start, end, device_code, F.sum("dau").alias("dau"), F.sum("active_devices").alias("active_devices")
    )


def session_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    return _by_day(marts, start, end, device_code, F.sum("total_sessions").alias("session_count"))


def sessions_per_user_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    mean = ratio(F.sum("total_sessions"), F.sum("dau"), 2)
    return _by_day(marts, start, end, device_code, mean.alias("avg_sessions"))


def newcomer_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    return _by_day(
        marts, start, end, device_code, F.sum("new_users").alias("new_users"), F.sum("new_devices").alias("new_devices")
    )


def _retention_trend(marts: Marts, start: str, end: str, who: str) -> DataFrame:
    return (
        in_range(marts.retention, start, end, ALL, day="base_dt")
        .select(
            F.col("base_dt").alias("base_date"),
            *[F.col(f"{n}_{who}_ret").cast("double").alias(f"{n}_{who}_retention_pct") for n in ("d1", "d7")],
        )
        .orderBy("base_date")
    )


def user_retention_trend(marts: Marts, start: str, end: str) -> DataFrame:
    return _retention_trend(marts, start, end, "user")


def device_retention_trend(marts: Marts, start: str, end: str) -> DataFrame:
    return _retention_trend(marts, start, end, "device")


def hours_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    return _by_day(marts, start, end, device_code, F.sum("total_duration_h").cast("double").alias("total_hours"))


def minutes_per_user_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    mean = ratio(F.sum("total_duration_sec"), F.sum("dau") * 60, 2)
    return _by_day(marts, start, end, device_code, mean.alias("avg_min_per_user"))


def mean_duration_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    mean = weighted_mean(F.col("avg_duration_min"), F.col("total_sessions"), 2)
    return _by_day(marts, start, end, device_code, mean.alias("avg_duration_min"))


def cumulative_hours_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Hours of the day, and the largest cumulative hours of a model in thousands."""
    thousands = F.round(F.max("cumulative_duration_h") / 1000, 3).cast("double")
    return _by_day(
        marts,
        start,
        end,
        device_code,
        F.sum("total_duration_h").cast("double").alias("daily_hours"),
        thousands.alias("cumulative_hours_k"),
    )


def funnel_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    return _by_day(
        marts,
        start,
        end,
        device_code,
        F.sum("power_on_cnt").alias("power_on_cnt"),
        F.sum("total_sessions").alias("started_cnt"),
        F.sum("complete_sessions").alias("ended_cnt"),
        F.sum("valid_sessions").alias("valid_cnt"),
    )


def funnel_rate_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Completed of started and valid of completed sessions, in percent."""
    started, complete, valid = F.sum("total_sessions"), F.sum("complete_sessions"), F.sum("valid_sessions")
    return _by_day(
        marts,
        start,
        end,
        device_code,
        ratio(complete * 100, started, 2).alias("completion_rate_pct"),
        ratio(valid * 100, complete, 2).alias("valid_rate_pct"),
    )


def user_day_bucket_trend(marts: Marts, start: str, end: str) -> DataFrame:
    """Users of each day by their number of sessions that day; over all models."""
    rows = sessions_per_user_day(in_range(marts.sessions, start, end))
    counts = rows.groupBy(
        F.col("evt_dt").alias("dt"), bucket_label(F.col("n"), SESSIONS_PER_DAY_SHORT).alias("session_bucket")
    ).agg(F.count("uid").alias("cnt_of_day"))
    return with_share(counts, "cnt_of_day", 4, by=["dt"], name="pct_of_day").orderBy("dt", "session_bucket")


def _mode_days(marts: Marts, start: str, end: str, device_code: str | None):
    rows = in_range(marts.session_modes, start, end, device_code)
    return rows.groupBy(F.col("evt_dt").alias("dt"), F.col("modeType").alias("mode_type"))


def mode_session_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Sessions per mode and day; the table key makes a session occur once per day and mode."""
    counts = _mode_days(marts, start, end, device_code).agg(F.count("useSessionId").alias("cnt"))
    return with_share(counts, "cnt", 5, by=["dt"]).orderBy("dt", "mode_type")


def mode_minutes_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    sums = _mode_days(marts, start, end, device_code).agg(F.sum("duration_sec").alias("sec"))
    rows = with_share(sums, "sec", 5, by=["dt"])
    return rows.select("dt", "mode_type", ratio(F.col("sec"), F.lit(60), 2).alias("dur_min"), "pct").orderBy(
        "dt", "mode_type"
    )
