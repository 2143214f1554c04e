"""Every report as a callable (spark, folder of test tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import testmap
from checks.params import (
    AS_OF_DEVICES,
    AS_OF_USERS,
    END,
    FIRMWARE_VERSIONS,
    FROM_DAY,
    GAP_DAY,
    MODEL,
    START,
    TO_DAY,
    USER_QUERY_COUNTRIES,
    USER_QUERY_SOURCES,
)
from checks.store import RETENTION_RANGE, TestMarts, shared_folder
from tidemark.functions.labels import STATUS_CODES, region_name, relabel
from tidemark.operators import distributions as dist, firmware, kpi, rollups, shaping, trends, userflags
from tidemark.operators.userflags import UserFilter
from tidemark.plans.chain import run_chain
from tidemark.marts import in_range
from tidemark.plans import state
from tidemark.plans.daily import POWER_ON, build_daily, cumulative, running_totals
from tidemark.plans.events import explode_events
from tidemark.plans.retention import build_retention
from tidemark.plans.sections import run_section
from tidemark.plans.sessions import (
    affected_start_days,
    build_session_modes,
    build_sessions,
    fold_hours,
    rebuild_start_days,
    touched_days,
)
from tidemark.sources.tables import read_table
from tidemark.sources.writers import latest_by_key, upsert, write_days

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double and all whole numbers as bigint, for comparison across engines."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            columns.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            columns.append(F.col(f"`{f.name}`").cast("bigint").alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return df.select(*columns)


def query(name: str, build: Callable[[TestMarts], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(build(TestMarts(spark, sf_dir)))


def report(name: str, tables: str, fn: Callable, *args, **options) -> None:
    """A report over the named marts."""
    query(name, lambda m: fn(m.marts(*tables.split()), *args, **options))


# ---- marts ----------------------------------------------------------------------------------------


def _resent(m: TestMarts) -> DataFrame:
    """Events of which a third arrives once more, written a second later."""
    rows = m.events.select("id", "dt", "writetime", "eventName")
    again = rows.where("id % 3 = 0").selectExpr("id", "dt", "writetime + 1000 as writetime", "'resent' as eventName")
    latest = latest_by_key(rows.unionByName(again), ["id", "dt"], [F.col("writetime")])
    return latest.select("id", "dt", "eventName")


def _two_loads(m: TestMarts) -> DataFrame:
    """The event table after two loads: newer copies of a third of the events first, then all events as they were."""
    root = f"{shared_folder(m.spark).rstrip('/')}/tidemark-loads-{uuid.uuid4().hex}"
    newer = m.events.where("id % 3 = 0").withColumns({"writetime": F.col("writetime") + 1000, "eventName": F.lit("resent")})
    for load in (newer, m.events):
        upsert(load, root, "events", [F.col("writetime")], dealt=True)
    return read_table(m.spark, root, "events").drop("writetime", "writetime_dt")


def _touched(m: TestMarts) -> DataFrame:
    """Every day with events in the last report days, rebuilt from all events known by then."""
    known = m.events.where(F.col("dt") <= F.lit(END).cast("date"))
    hours = fold_hours(known)
    ids = hours.join(touched_days(m.events, END, 2), "evt_dt", "left_semi").select("useSessionId")
    return rebuild_start_days(hours, affected_start_days(hours, ids))


def _chain(m: TestMarts) -> DataFrame:
    """Raw log to retention in one lazy plan, nothing written in between."""
    raw = testmap.raw_log(m.spark, m.sf_dir)
    return build_retention(build_sessions(explode_events(raw), "2024-02-07", 40), *RETENTION_RANGE)


def _chain_daily(m: TestMarts) -> DataFrame:
    """Raw log to the daily table, all columns, nothing written in between."""
    raw = testmap.raw_log(m.spark, m.sf_dir)
    power_ons = explode_events(raw, name=POWER_ON)
    return build_daily(build_sessions(explode_events(raw), "2024-02-07", 40), power_ons, "2024-02-07", 40)


def _days_between(start: str, end: str) -> list[date]:
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    return [first + timedelta(days=n) for n in range((last - first).days + 1)]


def _two_runs(m: TestMarts) -> DataFrame:
    """Sessions after the nightly job of two report days, the first of them run again on a corrected log."""
    root = f"{shared_folder(m.spark).rstrip('/')}/tidemark-chain-{uuid.uuid4().hex}"
    # The log of the two days is stored by day and read by each run, not made anew for every scan of it.
    write_days(testmap.raw_log(m.spark, m.sf_dir, [date(2024, 1, 27), date(2024, 1, 28)]), root, "raw", dealt=True)
    raw = read_table(m.spark, root, "raw")
    run_chain(m.spark, raw.where("id % 3 = 0"), root, "2024-01-27", dealt=True)
    run_chain(m.spark, raw, root, "2024-01-28", dealt=True)
    run_chain(m.spark, raw, root, "2024-01-27", dealt=True)
    return read_table(m.spark, root, "sessions")


query("m1_event_explode", lambda m: explode_events(m.raw))
query("m2_session_build", lambda m: build_sessions(m.events, "2024-02-07", 40))
query("m2_session_window", lambda m: build_sessions(m.events, END, 7))
query("m2_touched_rebuild", _touched)
query("m3_session_modes", lambda m: build_session_modes(m.events, "2024-02-07", 40))
query("m4_daily", lambda m: build_daily(m.sessions, m.events, "2024-02-07", 40))
query("m4_daily_power_by_model", lambda m: build_daily(m.sessions, m.events, "2024-02-07", 40, power_on_by_model=True))
query("m4_cumulative", lambda m: cumulative(m.sessions))
query("m5_retention", lambda m: build_retention(m.sessions, *RETENTION_RANGE))
query("m_chain_from_raw_log", _chain)
query("m_chain_daily_from_raw_log", _chain_daily)
query("m_chain_modes_from_raw_log", lambda m: build_session_modes(explode_events(testmap.raw_log(m.spark, m.sf_dir))))
query("m4_cumulative_from_increments", lambda m: running_totals(m.increments))
query("m5_retention_from_bits", lambda m: state.retention_from_bits(m.activity_bits, m.first_seen, _days_between(*RETENTION_RANGE)))
query("w1_latest_by_key", _resent)
query("w1_upsert_two_loads", _two_loads)
query("w2_nightly_sessions", lambda m: m.nightly.sessions)
query("w2_nightly_modes", lambda m: m.nightly.session_modes)
query("w2_nightly_daily", lambda m: m.nightly.daily)
query("w2_nightly_retention", lambda m: in_range(m.nightly.retention, *RETENTION_RANGE, day="base_dt"))
query("w2_chain_two_runs", _two_runs)
query("w3_retention_backfill", lambda m: build_retention(m.sessions, "2024-01-16", "2024-01-30"))

# ---- KPIs -----------------------------------------------------------------------------------------

SPAN = (START, END)
report("k0_device_codes", "daily", kpi.device_codes)
report("k1_overview_totals", "daily", kpi.overview_totals, *SPAN)
report("k1_overview_totals_model", "daily", kpi.overview_totals, *SPAN, MODEL)
report("k2_funnel_totals", "daily", kpi.funnel_totals, *SPAN)
report("k3_mean_d1_retention", "retention", kpi.mean_d1_retention, *SPAN)
report("k4_daily_snapshot", "daily", kpi.daily_snapshot, END)
report("k4_daily_snapshot_as_of", "daily", kpi.daily_snapshot, GAP_DAY)
report("k4b_seven_day_mean", "daily", kpi.seven_day_mean, END)
report("k4b_seven_day_mean_model", "daily", kpi.seven_day_mean, GAP_DAY, MODEL)
report("k5_yesterday_card", "daily retention", kpi.yesterday_card, END)
report("k5_yesterday_card_model", "daily retention", kpi.yesterday_card, END, MODEL)
report("k6_retention_summary", "daily retention", kpi.retention_summary, *SPAN)
report("k7_sessions_summary", "daily sessions", kpi.sessions_summary, *SPAN)
report("k8_sessions_yesterday", "daily sessions", kpi.sessions_yesterday, END)
report("k8_sessions_yesterday_model", "daily sessions", kpi.sessions_yesterday, GAP_DAY, MODEL)
report("k9_duration_summary", "daily", kpi.duration_summary, *SPAN)
report("k10_duration_yesterday", "daily", kpi.duration_yesterday, END)
report("k11_adjust_summary", "sessions", kpi.adjust_summary, *SPAN)
report("k12_pause_stats", "sessions", kpi.pause_stats, *SPAN)
report("k13_funnel_rates", "daily", kpi.funnel_rates, *SPAN)

# ---- trends ---------------------------------------------------------------------------------------

FUNNEL_SPAN = ("2023-12-30", END)  # the 30 days that end with END
report("t1_active_trend", "daily", trends.active_trend, *SPAN)
report("t2_session_trend", "daily", trends.session_trend, *SPAN)
report("t3_session_trend_model", "daily", trends.session_trend, *SPAN, MODEL)
report("t4_sessions_per_user_trend", "daily", trends.sessions_per_user_trend, *SPAN)
report("t5_newcomer_trend", "daily", trends.newcomer_trend, *SPAN)
report("t6_user_retention_trend", "retention", trends.user_retention_trend, *SPAN)
report("t7_device_retention_trend", "retention", trends.device_retention_trend, *SPAN)
report("t8_hours_trend", "daily", trends.hours_trend, *SPAN)
report("t9_minutes_per_user_trend", "daily", trends.minutes_per_user_trend, *SPAN)
report("t10_mean_duration_trend", "daily", trends.mean_duration_trend, *SPAN)
report("t11_cumulative_hours_trend", "daily", trends.cumulative_hours_trend, *SPAN)
report("t12_funnel_trend", "daily", trends.funnel_trend, *FUNNEL_SPAN)
report("t13_funnel_rate_trend", "daily", trends.funnel_rate_trend, *FUNNEL_SPAN)
report("t14_user_day_bucket_trend", "sessions", trends.user_day_bucket_trend, *SPAN)
report("t15_mode_session_trend", "session_modes", trends.mode_session_trend, *SPAN)
report("t16_mode_minutes_trend", "session_modes", trends.mode_minutes_trend, *SPAN)

# ---- distributions --------------------------------------------------------------------------------

report("b1_final_modes", "sessions", dist.final_modes, *SPAN)
report("b1_final_modes_model", "sessions", dist.final_modes, *SPAN, MODEL)
report("b2_suction_levels", "sessions", dist.suction_levels, *SPAN)
report("b3_top_hours", "sessions", dist.top_hours, *SPAN)
report("b3_all_hours", "sessions", dist.top_hours, *SPAN, top=None)
report("b4_streaks", "sessions", dist.streaks)
report("b4_streaks_range", "sessions", dist.streaks, "2024-01-10", "2024-01-16")
report("b4_streaks_from_bits", "activity_bits", dist.streaks_from_bits)
report("b4_streaks_from_bits_range", "activity_bits", dist.streaks_from_bits, "2024-01-10", "2024-01-16")
report("b5_user_day_buckets", "sessions", dist.user_day_buckets, *SPAN)
report("b6_user_totals", "sessions", dist.user_totals, *SPAN)
report("b7_device_totals", "sessions", dist.device_totals, *SPAN)
report("b8_duration_buckets", "sessions", dist.duration_buckets, *SPAN)
report("b9_mode_sessions", "session_modes", dist.mode_sessions, *SPAN)
report("b10_mode_minutes", "session_modes", dist.mode_minutes, *SPAN)
report("b10_mode_minutes_within_hour", "session_modes", dist.mode_minutes, *SPAN, longest_sec=3600)
report("b11_mode_sessions_per_user", "session_modes daily", dist.mode_sessions_per_user, *SPAN)
report("b12_mode_minutes_per_session", "session_modes", dist.mode_minutes_per_session, *SPAN)
report(
    "b12_mode_minutes_per_session_within_hour", "session_modes", dist.mode_minutes_per_session, *SPAN, longest_sec=3600
)
report("b13_hours_by_day_type", "sessions", dist.hours_by_day_type, *SPAN)
report("b13_hours_by_event_weekday", "sessions", dist.hours_by_day_type, *SPAN, MODEL, weekday_source="evt_dt")
report("b14_mode_by_level", "sessions", dist.mode_by_level, *SPAN)
report("b15_modes_used", "sessions", dist.modes_used, *SPAN)
report("b16_mode_transitions", "events", dist.mode_transitions, *SPAN)
report("b16_mode_transitions_changed", "events", dist.mode_transitions, *SPAN, top=100, keep_self=False)
report("b17_level_directions", "sessions", dist.level_directions, *SPAN)
report("b18_adjusts_per_session", "sessions", dist.adjusts_per_session, *SPAN)
report("b19_event_sources", "events", dist.event_sources, *SPAN)
report(
    "b19_event_sources_sessions",
    "events",
    dist.event_sources,
    *SPAN,
    event_names=("pump_session_start", "pump_session_end", "pump_manual_adjust_evt"),
)
report("b20_weekly_cohorts", "sessions", dist.weekly_cohorts, *SPAN)
report("b20_weekly_cohorts_model", "sessions", dist.weekly_cohorts, *SPAN, MODEL)
report("b20_weekly_cohorts_from_bits", "activity_bits first_seen", dist.weekly_cohorts_from_bits, *SPAN)
report("b20_weekly_cohorts_from_bits_model", "activity_bits first_seen", dist.weekly_cohorts_from_bits, *SPAN, MODEL)

# ---- the same reports from the roll-up mart -----------------------------------------------------------

ROLLED = {
    "k11_adjust_summary": rollups.adjust_summary,
    "k12_pause_stats": rollups.pause_stats,
    "t15_mode_session_trend": rollups.mode_session_trend,
    "t16_mode_minutes_trend": rollups.mode_minutes_trend,
    "b1_final_modes": rollups.final_modes,
    "b2_suction_levels": rollups.suction_levels,
    "b3_top_hours": rollups.top_hours,
    "b8_duration_buckets": rollups.duration_buckets,
    "b9_mode_sessions": rollups.mode_sessions,
    "b10_mode_minutes": rollups.mode_minutes,
    "b12_mode_minutes_per_session": rollups.mode_minutes_per_session,
    "b13_hours_by_day_type": rollups.hours_by_day_type,
    "b14_mode_by_level": rollups.mode_by_level,
    "b15_modes_used": rollups.modes_used,
    "b17_level_directions": rollups.level_directions,
    "b18_adjusts_per_session": rollups.adjusts_per_session,
}
for _name, _fn in ROLLED.items():
    report(f"{_name}_from_rollups", "rollups", _fn, *SPAN)
report("b1_final_modes_from_rollups_model", "rollups", rollups.final_modes, *SPAN, MODEL)
report("b11_mode_sessions_per_user_from_rollups", "rollups daily", rollups.mode_sessions_per_user, *SPAN)
report("b13_hours_by_event_weekday_from_rollups", "rollups", rollups.hours_by_day_type, *SPAN, MODEL, weekday_source="evt_dt")

# ---- user flags -----------------------------------------------------------------------------------

ANY = UserFilter()
LISTS = UserFilter(USER_QUERY_COUNTRIES, USER_QUERY_SOURCES)
SPAN_FILTER = UserFilter(USER_QUERY_COUNTRIES, USER_QUERY_SOURCES, date_from=FROM_DAY, date_to=TO_DAY, date_days="7")
ACTIVE_FILTER = UserFilter(USER_QUERY_COUNTRIES, USER_QUERY_SOURCES, active_status="1", date_from=FROM_DAY, date_to=TO_DAY)


def _flags(name: str, fn: Callable, chosen: UserFilter = ANY, columns: list[str] | None = None) -> None:
    def build(m: TestMarts) -> DataFrame:
        df = fn(m.user_flags, chosen, AS_OF_USERS)
        return df.select(*columns) if columns else df

    query(name, build)


_flags(
    "u1_filtered_records",
    userflags.apply_filter,
    ACTIVE_FILTER,
    ["uid", "country_ad_ch", "data_source", "active_status", "event_date"],
)
_flags("u1_filtered_last_days", userflags.apply_filter, UserFilter(date_days="90"), ["uid", "country_ad_ch", "event_date"])
query("u2_filter_options", lambda m: userflags.filter_options(m.user_flags))
_flags("u3_overview", userflags.overview)
_flags("u3_overview_filtered", userflags.overview, SPAN_FILTER)
_flags("u3_overview_nobody", userflags.overview, UserFilter(countries=["nowhere"]))
_flags("u4_active_users", userflags.active_users)
_flags("u5_active_rate", userflags.overview, ANY, ["active_users", "inactive_users", "active_rate"])
_flags("u6_users_by_source", userflags.users_by_source, UserFilter(date_days="90"))
_flags("u7_top_countries", userflags.top_countries, UserFilter(date_days="x"))
_flags("u8_daily_users", userflags.daily_users, UserFilter(date_days="900"))
_flags("u9_flag_counts", userflags.flag_counts, LISTS)
_flags("u9_flag_counts_long", userflags.flag_counts_long)

# ---- firmware -------------------------------------------------------------------------------------


def _labels(m: TestMarts) -> DataFrame:
    status = relabel(F.col("status"), {code: name for name, code in STATUS_CODES.items()}, F.col("status").cast("string"))
    rows = m.devices.groupBy(region_name(F.col("data_source")).alias("region"), status.alias("status"))
    return rows.agg(F.count("*").alias("devices"))


def _matrix(m: TestMarts, as_of: str, versions: list[str] | None = None) -> DataFrame:
    trend = firmware.version_trend(m.devices, AS_OF_DEVICES, model="purchase", region="EU", status="unbound")
    return firmware.version_matrix(trend, as_of, versions) if versions else firmware.zero_filled(trend, as_of)


query("f1_version_trend", lambda m: firmware.version_trend(m.devices, AS_OF_DEVICES))
query(
    "f1_version_trend_filtered",
    lambda m: firmware.version_trend(m.devices, AS_OF_DEVICES, model="click", region="Europe", status="bound"),
)
query("f2_region_status_labels", _labels)
query("f3_filter_options", lambda m: firmware.filter_options(m.devices))
query("f4_versions_bound", lambda m: firmware.version_distribution(m.devices, "bound"))
query(
    "f4_versions_unbound_filtered",
    lambda m: firmware.version_distribution(m.devices, "unbound", model="view", region="Asia-Pacific"),
)
query("f5_version_matrix", lambda m: _matrix(m, AS_OF_DEVICES))
query("f5_version_matrix_fallback", lambda m: _matrix(m, "2024-07-30"))
query("f5_version_matrix_wide", lambda m: _matrix(m, AS_OF_DEVICES, FIRMWARE_VERSIONS))
query("f6_device_details", lambda m: firmware.device_details(m.devices))
query(
    "f6_device_details_filtered",
    lambda m: firmware.device_details(m.devices, model="error", region="US-East", status="unbound"),
)
query(
    "f7_version_domain",
    lambda m: firmware.version_domain(
        firmware.version_distribution(m.devices, "bound"), firmware.version_distribution(m.devices, "unbound")
    ),
)

# ---- shaping --------------------------------------------------------------------------------------

query("j1_clip", lambda m: shaping.clip(trends.session_trend(m.marts("daily"), *SPAN), "2024-01-10", "2024-01-12"))
query(
    "j1_clip_base_date",
    lambda m: shaping.clip(trends.user_retention_trend(m.marts("retention"), *SPAN), "2024-01-10", "2024-01-12"),
)
query("j2_shares", lambda m: shaping.shares(dist.mode_sessions(m.marts("session_modes"), *SPAN), "cnt"))
query(
    "j3_percent_bars",
    lambda m: shaping.percent_bars(
        dist.top_hours(m.marts("sessions"), *SPAN, top=24), "pct", [F.desc("pct"), "local_hour"]
    ),
)
query(
    "j3_number_bars",
    lambda m: shaping.number_bars(dist.mode_minutes(m.marts("session_modes"), *SPAN), "duration_min", [F.desc("duration_min")]),
)

# ---- sections: every row of every frame, as text ---------------------------------------------------------------------

SECTION_TABLES = {
    "overview": "daily retention sessions",
    "retention": "daily retention sessions",
    "sessions": "daily sessions session_modes",
    "duration": "daily sessions session_modes",
    "habits": "sessions events",
    "funnel": "daily",
    "firmware": "devices",
}


NUMBER = "^-?[0-9]+([.][0-9]+)?(E-?[0-9]+)?$"


def _as_text(frame: str, df: DataFrame) -> DataFrame:
    """Rows as ``column=value`` texts, columns by name and numbers with six decimals."""
    parts = []
    for name in sorted(df.columns):
        text = F.col(f"`{name}`").cast("string")
        number = F.format_string("%.6f", F.when(text.rlike(NUMBER), text.try_cast("double")))
        parts.append(F.concat(F.lit(f"{name}="), F.when(text.rlike(NUMBER), number).otherwise(F.coalesce(text, F.lit("null")))))
    return df.select(F.lit(frame).alias("frame"), F.concat_ws(", ", *parts).alias("row"))


def _section(name: str, tables: str | None = None) -> Callable[[TestMarts], DataFrame]:
    def build(m: TestMarts) -> DataFrame:
        frames = run_section(m.marts(*(tables or SECTION_TABLES[name]).split()), name, *SPAN, as_of=AS_OF_DEVICES)
        return reduce(DataFrame.unionByName, [_as_text(frame, plain(df)) for frame, df in frames.items()])

    return build


for _name in SECTION_TABLES:
    query(f"w4_section_{_name}", _section(_name))

# Sections over the roll-up mart; sessions and session modes are given only where users or devices are counted.
ROLLED_TABLES = {
    "overview": "daily retention rollups",
    "sessions": "daily sessions rollups",
    "duration": "daily rollups",
    "habits": "events rollups",
}
for _name, _tables in ROLLED_TABLES.items():
    query(f"w4_section_{_name}_from_rollups", _section(_name, _tables))
