"""Distributions, rankings, cross tables and cohorts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import buckets as b
from tidemark.functions.labels import MODE_NAMES, SOURCE_NAMES, relabel
from tidemark.functions.measures import first_rows, ratio, with_share
from tidemark.marts import Marts, as_date, in_range
from tidemark.operators.kpi import sessions_per_user_day
from tidemark.plans import state
from tidemark.plans.retention import active_days

# Event names and types of the log.
SOURCE_EVENTS = ("pump_start", "pump_end", "pump_manual_adjust_evt")
COHORT_DAYS = (1, 3, 7, 14)


def _distinct_sessions(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Distinct session ids per key.

    Spark counts in two steps, on (key, session) and then on key, so few or uneven keys do not
    gather the sessions of a key in one task.
    """
    return rows.groupBy(*keys).agg(F.countDistinct("useSessionId").alias("session_count"))


def final_modes(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = in_range(marts.sessions, start, end, device_code).where(F.col("finalModeType").isNotNull())
    counts = _distinct_sessions(rows, F.col("finalModeType").alias("mode_type"))
    return with_share(counts, "session_count", 5).orderBy(F.desc("session_count"), "mode_type")


def suction_levels(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Final levels in four buckets; the last one also takes 0, levels above 9 and text that is no number."""
    level = b.suction_level(F.col("finalSuctionLevel"))
    rows = in_range(marts.sessions, start, end, device_code).where(F.col("finalSuctionLevel").isNotNull())
    rows = b.with_bucket(rows, level, b.SUCTION_LEVEL, "level_bucket")
    counts = _distinct_sessions(rows, "level_bucket", "bucket_order")
    return with_share(counts, "session_count", 5).orderBy("bucket_order")


def top_hours(marts: Marts, start: str, end: str, device_code: str | None = None, top: int | None = 6) -> DataFrame:
    """Busiest local hours, all of them for ``top=None``; the share is of all hours. Equal counts: the earlier hour first."""
    rows = in_range(marts.sessions, start, end, device_code).where(F.col("local_hour").isNotNull())
    counts = with_share(_distinct_sessions(rows, "local_hour"), "session_count", 5)
    return first_rows(counts.orderBy(F.desc("session_count"), "local_hour"), top)


def longest_streak(days: Column) -> Column:
    """Length of the longest run of consecutive dates in an array of distinct dates.

    In a sorted run the date minus its position stays the same, so runs are counted by that key.
    """
    keys = F.transform(F.array_sort(days), lambda day, i: F.date_sub(day, i))
    start = F.struct(
        F.lit(None).cast("date").alias("key"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(acc: Column, key: Column) -> Column:
        run = F.when(acc["key"] == key, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(key.alias("key"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(keys, start, step, lambda acc: acc["best"])


def streaks(marts: Marts, start: str | None = None, end: str | None = None) -> DataFrame:
    """Users by their longest run of consecutive active days, over all history unless a range is given.

    Sessions are reduced map-side to one set of dates per user, so the only shuffle over the facts
    carries at most one date per user and day.
    """
    sessions = marts.sessions.where(F.col("uid").isNotNull())
    if start:
        sessions = sessions.where(F.col("evt_dt") >= as_date(start))
    if end:
        sessions = sessions.where(F.col("evt_dt") <= as_date(end))
    return _streak_buckets(active_days(sessions))


def streaks_from_bits(marts: Marts, start: str | None = None, end: str | None = None) -> DataFrame:
    """``streaks`` from the kept bits of active days: a row per user and 32 days in place of sessions."""
    bits = marts.activity_bits.where((F.col("kind") == "user") & F.col("id").isNotNull())
    bits = state.bits_between(bits, start and date.fromisoformat(start), end and date.fromisoformat(end))
    months = bits.groupBy("id", "period").agg(F.bit_or("bits").alias("bits"))  # all models of a user
    spans = months.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("period", "bits"))).alias("spans"))
    return _streak_buckets(spans.select(F.flatten(F.transform("spans", lambda x: state.dates_of(x["period"], x["bits"]))).alias("days")))


def _streak_buckets(users: DataFrame) -> DataFrame:
    users = users.select(longest_streak(F.col("days")).alias("n"))
    users = b.with_bucket(users, F.col("n"), b.STREAK_DAYS, "streak_bucket")
    counts = users.groupBy("streak_bucket", "bucket_order").agg(F.count("*").alias("user_count"))
    return with_share(counts, "user_count", 4).orderBy("bucket_order")


def user_day_buckets(marts: Marts, start: str, end: str) -> DataFrame:
    """User-days by number of sessions; over all models."""
    rows = sessions_per_user_day(in_range(marts.sessions, start, end))
    rows = b.with_bucket(rows, F.col("n"), b.SESSIONS_PER_DAY, "session_bucket")
    counts = rows.groupBy("session_bucket", "bucket_order").agg(F.count("*").alias("user_day_count"))
    return with_share(counts, "user_day_count", 4).orderBy("bucket_order")


def _total_buckets(sessions: DataFrame, key: str, name: str) -> DataFrame:
    rows = sessions.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("useSessionId").alias("n"))
    rows = b.with_bucket(rows, F.col("n"), b.SESSIONS_IN_TOTAL, "cumulative_bucket")
    counts = rows.groupBy("cumulative_bucket", "bucket_order").agg(F.count(key).alias(name))
    return with_share(counts, name, 4).orderBy("bucket_order")


def user_totals(marts: Marts, start: str, end: str) -> DataFrame:
    """Users by sessions in the range; over all models."""
    return _total_buckets(in_range(marts.sessions, start, end), "uid", "user_count")


def device_totals(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Devices by sessions in the range."""
    return _total_buckets(in_range(marts.sessions, start, end, device_code), "pump_device_id", "device_count")


def duration_buckets(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Sessions in five-minute buckets of their length."""
    rows = in_range(marts.sessions, start, end, device_code).where(F.col("total_duration_sec").isNotNull())
    rows = b.with_bucket(rows, F.col("total_duration_sec"), b.DURATION_SEC, "duration_bucket")
    counts = rows.groupBy("duration_bucket", "bucket_order").agg(F.count("useSessionId").alias("session_count"))
    return with_share(counts, "session_count", 4).orderBy("bucket_order")


# ---- session x mode -------------------------------------------------------------------------------


def _modes(marts: Marts, start: str, end: str, device_code: str | None) -> DataFrame:
    return in_range(marts.session_modes, start, end, device_code).withColumnRenamed("modeType", "mode_type")


def mode_sessions(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    counts = _distinct_sessions(_modes(marts, start, end, device_code), "mode_type")
    return counts.withColumnRenamed("session_count", "cnt").orderBy(F.desc("cnt"), "mode_type")


def _no_longer(rows: DataFrame, longest_sec: int | None) -> DataFrame:
    return rows if longest_sec is None else rows.where(F.col("duration_sec") <= longest_sec)


def mode_minutes(
    marts: Marts, start: str, end: str, device_code: str | None = None, longest_sec: int | None = None
) -> DataFrame:
    """Minutes by mode; ``longest_sec`` leaves out longer session-mode rows."""
    rows = _no_longer(_modes(marts, start, end, device_code), longest_sec)
    sums = rows.groupBy("mode_type").agg(ratio(F.sum("duration_sec"), F.lit(60), 2).alias("duration_min"))
    return sums.orderBy(F.desc("duration_min"), "mode_type")


def mode_sessions_per_user(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Sessions with the mode per daily active user, over the days on which the mode occurs.

    Both sides hold a row per day (and mode) only; Spark chooses the join by their size.
    """
    modes = (
        _modes(marts, start, end, device_code)
        .groupBy("evt_dt", "mode_type")
        .agg(F.count("useSessionId").alias("sessions"))
    )
    users = in_range(marts.daily, start, end, device_code).groupBy("evt_dt").agg(F.sum("dau").alias("dau"))
    rows = modes.join(users, "evt_dt").groupBy("mode_type")
    mean = ratio(F.sum("sessions"), F.sum("dau"), 4).alias("avg_sess_per_user")
    return rows.agg(mean).orderBy(F.desc("avg_sess_per_user"), "mode_type")


def mode_minutes_per_session(
    marts: Marts, start: str, end: str, device_code: str | None = None, longest_sec: int | None = None
) -> DataFrame:
    """Mean minutes per session by mode; ``longest_sec`` leaves out longer session-mode rows."""
    rows = _no_longer(_modes(marts, start, end, device_code), longest_sec)
    mean = ratio(F.sum("duration_sec"), F.countDistinct("useSessionId") * 60, 2).alias("avg_dur_per_sess_min")
    return rows.groupBy("mode_type").agg(mean).orderBy(F.desc("avg_dur_per_sess_min"), "mode_type")


# ---- habits ---------------------------------------------------------------------------------------


def hours_by_day_type(
    marts: Marts, start: str, end: str, device_code: str | None = None, weekday_source: str = "stored"
) -> DataFrame:
    """Local hours of weekdays and weekends, share within the day type.

    ``weekday_source="evt_dt"`` takes the weekday from the event date instead of the stored flag and
    ignores dates outside 2020-2030.
    """
    rows = in_range(marts.sessions, start, end, device_code).where(F.col("local_hour").isNotNull())
    if weekday_source == "evt_dt":
        rows = rows.where(F.year("evt_dt").between(2020, 2030))
        rows = rows.withColumn("is_weekday", F.when(F.dayofweek("evt_dt").between(2, 6), 1).otherwise(0))
    label = F.when(F.col("is_weekday") == 1, "weekday").otherwise("weekend").alias("day_type")
    counts = _distinct_sessions(rows, label, "is_weekday", "local_hour")
    shares = with_share(counts, "session_count", 5, by=["is_weekday"])
    return shares.drop("is_weekday").orderBy("day_type", "local_hour")


def mode_by_level(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Final mode x final level bucket, share within the mode."""
    rows = in_range(marts.sessions, start, end, device_code).where(
        F.col("finalModeType").isNotNull() & F.col("finalSuctionLevel").isNotNull()
    )
    bucket = b.bucket_label(b.suction_level(F.col("finalSuctionLevel")), b.SUCTION_LEVEL)
    counts = _distinct_sessions(rows, F.col("finalModeType").alias("final_mode"), bucket.alias("level_bucket"))
    shares = with_share(counts, "session_count", 4, by=["final_mode"], name="pct_within_mode")
    return shares.orderBy("final_mode", "level_bucket")


def modes_used(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = in_range(marts.sessions, start, end, device_code).where(F.col("usedModeCount").isNotNull())
    rows = b.with_bucket(rows, F.col("usedModeCount"), b.MODES_USED, "mode_mix_type")
    counts = _distinct_sessions(rows, "mode_mix_type", "bucket_order")
    return with_share(counts, "session_count", 4).orderBy("bucket_order")


def mode_transitions(marts: Marts, start: str, end: str, top: int | None = 6, keep_self: bool = True) -> DataFrame:
    """Most frequent mode changes; the share is of all changes. Reads events, over all models."""
    rows = in_range(marts.events, start, end).where(
        (F.col("eventName") == "pump_manual_adjust_evt")
        & (F.col("evtType") == "pump_mode")
        & F.col("adjustFrom").isNotNull()
        & F.col("adjustTo").isNotNull()
    )
    if not keep_self:
        rows = rows.where(F.col("adjustFrom") != F.col("adjustTo"))
    # Group by the stored codes; labels are added to the few result rows.
    counts = rows.groupBy("adjustFrom", "adjustTo").agg(F.count("*").alias("n"))
    counts = counts.groupBy(
        relabel(F.col("adjustFrom"), MODE_NAMES).alias("from_mode"),
        relabel(F.col("adjustTo"), MODE_NAMES).alias("to_mode"),
    ).agg(F.sum("n").alias("adjust_count"))
    counts = counts.withColumn("adjust_path", F.concat("from_mode", F.lit(" → "), "to_mode"))
    return first_rows(with_share(counts, "adjust_count", 4).orderBy(F.desc("adjust_count"), "adjust_path"), top)


def level_directions(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Level changes up, down and without effect: one scan, then three rows."""
    level, up, down = F.col("level_adj_cnt"), F.col("level_up_cnt"), F.col("level_down_cnt")
    sums = in_range(marts.sessions, start, end, device_code).agg(
        F.sum(up).alias("up"), F.sum(down).alias("down"), F.sum(level - up - down).alias("same")
    )
    rows = sums.unpivot([], ["up", "down", "same"], "direction", "adjust_count")
    counted = rows.withColumn("n", F.coalesce("adjust_count", F.lit(0)))
    return with_share(counted, "n", 4).drop("n")


def adjusts_per_session(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Sessions by number of level changes and by number of mode changes, 10 and more together.

    One scan for both: each session contributes a row per kind, counted map-side. ``kind`` tells the two apart.
    """
    rows = in_range(marts.sessions, start, end, device_code).select(
        F.explode(
            F.array(
                F.struct(F.lit("level").alias("kind"), F.col("level_adj_cnt").alias("n")),
                F.struct(F.lit("mode").alias("kind"), F.col("mode_adj_cnt").alias("n")),
            )
        ).alias("x")
    )
    n = F.when(F.col("x.n") >= 10, F.lit(10)).otherwise(F.col("x.n"))
    counts = rows.groupBy(F.col("x.kind").alias("kind"), n.alias("bucket_order")).agg(
        F.count("*").alias("session_count")
    )
    label = F.when(F.col("bucket_order") >= 10, "10+").otherwise(F.col("bucket_order").cast("string"))
    counts = counts.withColumn("adj_bucket", label)
    return with_share(counts, "session_count", 4, by=["kind"]).orderBy("kind", "bucket_order")


def event_sources(marts: Marts, start: str, end: str, event_names: tuple[str, ...] = SOURCE_EVENTS) -> DataFrame:
    """Where operations come from (app or hardware), from events."""
    rows = in_range(marts.events, start, end).where(
        F.col("evtSource").isNotNull() & F.col("eventName").isin(*event_names)
    )
    label = relabel(F.col("evtSource"), SOURCE_NAMES).alias("source_type")
    counts = rows.groupBy(label).agg(F.count("*").alias("event_count"))
    return with_share(counts, "event_count", 4).orderBy(F.desc("event_count"), "source_type")


def weekly_cohorts(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Users by week of their first day in start..end, and the share active exactly 1, 3, 7, 14 days later.

    First day and later activity come from the same set of dates per user: one shuffle, no join.
    """
    known = marts.sessions.where(F.col("uid").isNotNull())
    known = known.where(F.col("evt_dt") <= F.date_add(as_date(end), max(COHORT_DAYS)))
    if device_code:
        known = known.where(F.col("deviceCode") == device_code)
    users = active_days(known).select(F.array_min("days").alias("first_day"), "days")
    users = users.where(F.col("first_day").between(as_date(start), as_date(end)))

    def stayed(n: int) -> Column:
        return F.array_contains("days", F.date_add("first_day", n))

    return _cohort_weeks(users, stayed)


def weekly_cohorts_from_bits(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """``weekly_cohorts`` from the ledger of first sightings and the bits of active days; sessions are not read."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    known = (F.col("kind") == "user") & F.col("id").isNotNull()
    ledger = marts.first_seen.where(known & F.col("day").between(first, last))
    ledger = ledger.where(F.col("deviceCode") == device_code if device_code else F.col("is_one"))
    near = range(state.period_of(first), state.period_of(last + timedelta(days=max(COHORT_DAYS))) + 1)
    bits = marts.activity_bits.where(known & F.col("period").isin(list(near)))
    if device_code:
        bits = bits.where(F.col("deviceCode") == device_code)
    users = state.with_neighbours(bits, ledger).where("first != 0")
    users = users.withColumn("first_day", state.dates_of(F.col("period"), F.col("first"))[0])

    def stayed(n: int) -> Column:
        return F.col("first").bitwiseAND(state.ahead(F.col("cur"), F.col("next"), n)) != 0

    return _cohort_weeks(users, stayed)


def _cohort_weeks(users: DataFrame, stayed: Callable[[int], Column]) -> DataFrame:
    return (
        users.groupBy(F.date_trunc("week", "first_day").cast("date").alias("install_week"))
        .agg(
            F.count("*").alias("new_users"),
            *[ratio(F.count_if(stayed(n)), F.count("*"), 4).alias(f"d{n}_pct") for n in COHORT_DAYS],
        )
        .orderBy("install_week")
    )
