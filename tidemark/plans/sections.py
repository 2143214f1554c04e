"""Bundles: all frames of one dashboard section."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from tidemark.marts import Marts
from tidemark.operators import distributions as dist, firmware, kpi, rollups, trends
from tidemark.operators.userflags import UserFilter, dashboard

# The dashboard's sections.
SECTIONS = ("overview", "retention", "sessions", "duration", "habits", "funnel", "firmware")
# Fixed value: the funnel trend always shows this many days up to the end.
FUNNEL_DAYS = 30


def run_section(
    marts: Marts, section: str, start: str, end: str, device_code: str | None = None, as_of: str | None = None
) -> dict[str, DataFrame]:
    """Lazy frames of a section by name.

    Nothing runs here, and the model filter is an argument, so sections of different users do not
    affect each other. The daily and retention tables and the roll-up mart hold a few rows per day: frames that share them
    re-read little. With the roll-up mart, sessions are read only where single users or devices are counted; without it
    they are scanned with only the columns of each frame.
    """
    rolled = marts.rollups is not None
    counts, habits, modes = (rollups, rollups, rollups) if rolled else (dist, kpi, trends)
    span = (start, end)
    own = (start, end, device_code)
    if section == "overview":
        totals = kpi.overview_totals(marts, *own)
        extra = totals.select(
            "total_duration_hours", "avg_duration_min", "devices_per_user", "valid_session_rate_pct"
        )
        d1 = kpi.mean_d1_retention(marts, *span).withColumnRenamed("d1_user_ret", "d1_retention_pct")
        return {
            "kpi01": totals.select("total_users", "total_devices", "total_sessions", "avg_sessions_per_user"),
            "kpi01_extra": kpi.one_row(extra, d1),
            "kpi_yesterday": kpi.yesterday_card(marts, end, device_code),
            "active_trend": trends.active_trend(marts, *own),
            "session_trend": trends.session_trend(marts, *own),
            "final_modes": counts.final_modes(marts, *own),
            "suction_levels": counts.suction_levels(marts, *own),
            "top_hours": counts.top_hours(marts, *own),
        }
    if section == "retention":
        return {
            "summary": kpi.retention_summary(marts, *own),
            "user_retention": trends.user_retention_trend(marts, *span),
            "device_retention": trends.device_retention_trend(marts, *span),
            "newcomers": trends.newcomer_trend(marts, *own),
            "streaks": dist.streaks(marts),
            "weekly_cohorts": dist.weekly_cohorts(marts, *own),
        }
    if section == "sessions":
        totals = kpi.overview_totals(marts, *own)
        return {
            "kpi01": totals.select("total_sessions", "avg_sessions_per_user"),
            "summary": kpi.sessions_summary(marts, *own),
            "kpi_yesterday": kpi.sessions_yesterday(marts, end, device_code),
            "session_trend": trends.session_trend(marts, *own),
            "sessions_per_user": trends.sessions_per_user_trend(marts, *own),
            "user_day_buckets": dist.user_day_buckets(marts, *span),
            "user_day_bucket_trend": trends.user_day_bucket_trend(marts, *span),
            "user_totals": dist.user_totals(marts, *span),
            "device_totals": dist.device_totals(marts, *own),
            "mode_sessions": counts.mode_sessions(marts, *own),
            "mode_session_trend": modes.mode_session_trend(marts, *own),
            "mode_sessions_per_user": counts.mode_sessions_per_user(marts, *own),
        }
    if section == "duration":
        return {
            "summary": kpi.duration_summary(marts, *own),
            "kpi_yesterday": kpi.duration_yesterday(marts, end),
            "hours_trend": trends.hours_trend(marts, *own),
            "minutes_per_user": trends.minutes_per_user_trend(marts, *own),
            "duration_buckets": counts.duration_buckets(marts, *own),
            "mean_duration": trends.mean_duration_trend(marts, *own),
            "cumulative_hours": trends.cumulative_hours_trend(marts, *own),
            "mode_minutes": counts.mode_minutes(marts, *own),
            "mode_minutes_trend": modes.mode_minutes_trend(marts, *own),
            "mode_minutes_per_session": counts.mode_minutes_per_session(marts, *own),
        }
    if section == "habits":
        adjusts = counts.adjusts_per_session(marts, *own)
        return {
            "hours_by_day_type": counts.hours_by_day_type(marts, *own),
            "mode_by_level": counts.mode_by_level(marts, *own),
            "modes_used": counts.modes_used(marts, *own),
            "mode_transitions": dist.mode_transitions(marts, *span),
            "level_directions": counts.level_directions(marts, *own),
            "level_adjusts": adjusts.where(F.col("kind") == "level").drop("kind"),
            "mode_adjusts": adjusts.where(F.col("kind") == "mode").drop("kind"),
            "adjust_summary": habits.adjust_summary(marts, *own),
            "pause_stats": habits.pause_stats(marts, *own),
            "event_sources": dist.event_sources(marts, *span),
        }
    if section == "funnel":
        trend_start = (date.fromisoformat(end) - timedelta(days=FUNNEL_DAYS - 1)).isoformat()
        recent = (trend_start, end, device_code)
        return {
            "kpi02": kpi.funnel_totals(marts, *own),
            "funnel": kpi.funnel_rates(marts, *own),
            "funnel_trend": trends.funnel_trend(marts, *recent),
            "funnel_rate_trend": trends.funnel_rate_trend(marts, *recent),
        }
    if section == "firmware":
        # As published, this section ignores the date range and the model filter.
        devices = marts.devices
        return {
            "bound": firmware.version_distribution(devices, "bound"),
            "unbound": firmware.version_distribution(devices, "unbound"),
            "trend": firmware.version_trend(devices, as_of or end),
            "detail": firmware.device_details(devices),
        }
    raise ValueError(f"unknown section: {section}")


def run_user_dashboard(marts: Marts, chosen: UserFilter, as_of: str) -> dict[str, DataFrame]:
    return dashboard(marts.user_flags, chosen, as_of)
