"""Headline numbers: totals over a range, the latest day against earlier ones, funnel rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.measures import delta_pct, delta_pp, hundredths, one_row, ratio, weighted_mean
from tidemark.marts import Marts, as_date, in_range

ALL = "ALL"


def device_codes(marts: Marts) -> DataFrame:
    """Device models to choose from."""
    code = F.col("deviceCode")
    return marts.daily.where(code.isNotNull() & (code != ALL)).select("deviceCode").distinct().orderBy("deviceCode")


def overview_totals(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Totals of the range. User and device totals are the largest cumulative value of a single model row."""
    users, devices, sessions = F.max("cumulative_users"), F.max("cumulative_devices"), F.sum("total_sessions")
    return in_range(marts.daily, start, end, device_code).agg(
        users.alias("total_users"),
        devices.alias("total_devices"),
        sessions.alias("total_sessions"),
        ratio(sessions, users, 0).alias("avg_sessions_per_user"),
        ratio(F.sum("valid_sessions"), sessions, 5).alias("valid_session_rate_pct"),
        F.sum("total_duration_h").cast("double").alias("total_duration_hours"),
        ratio(F.sum("total_duration_sec"), sessions * 60, 2).alias("avg_duration_min"),
        ratio(devices, users, 4).alias("devices_per_user"),
    )


def funnel_totals(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    return in_range(marts.daily, start, end, device_code).agg(
        F.sum("power_on_cnt").alias("power_on_cnt"),
        F.max("cumulative_devices").alias("total_devices"),
        F.sum("total_sessions").alias("started_sessions"),
        F.sum("complete_sessions").alias("ended_sessions"),
        F.sum("valid_sessions").alias("valid_sessions"),
    )


def funnel_rates(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Step rates in percent; both later steps are relative to the started sessions."""
    steps = {
        name: F.coalesce(F.col(name), F.lit(0))
        for name in ("power_on_cnt", "started_sessions", "ended_sessions", "valid_sessions")
    }
    power, started, ended, valid = steps.values()
    return funnel_totals(marts, start, end, device_code).select(
        *[value.alias(name) for name, value in steps.items()],
        _percent(started, power).alias("start_rate_pct"),
        _percent(ended, started).alias("completion_rate_pct"),
        _percent(valid, started).alias("valid_rate_pct"),
    )


def _percent(num: Column, den: Column) -> Column:
    return F.bround(ratio(num * 100, den), 1)


def mean_d1_retention(marts: Marts, start: str, end: str) -> DataFrame:
    rows = in_range(marts.retention, start, end, ALL, day="base_dt")
    return rows.agg(F.round(F.avg("d1_user_ret"), 5).cast("double").alias("d1_user_ret"))


# ---- latest day, previous day and seven-day mean --------------------------------------------------

# Metric -> decimals of its snapshot, and of its seven-day mean.
SNAPSHOT_DIGITS = {
    "dau": (None, 0),
    "active_devices": (None, 0),
    "new_users": (None, 0),
    "new_devices": (None, 0),
    "sessions": (None, 0),
    "duration_hours": (2, 2),
    "avg_dur_min": (2, 2),
    "valid_rate": (5, 5),
    "avg_sessions_per_user": (2, 2),
    "dur_per_user_min": (2, 2),
    "power_on_cnt": (None, 0),
    "complete_sessions": (None, 0),
    "valid_sessions": (None, 0),
}


def _day_metrics(daily: DataFrame, device_code: str | None, names: list[str]) -> DataFrame:
    """Unrounded metrics per day over all models, and over the chosen model only (suffix ``_own``)."""

    def metrics(test: Column | None) -> dict[str, Column]:
        def only(value: Column) -> Column:
            return value if test is None else F.when(test, value)

        def total(name: str) -> Column:
            return F.sum(only(F.col(name)))

        minutes = F.sum(only(F.col("avg_duration_min") * F.col("total_sessions")))
        return {
            "dau": total("dau"),
            "active_devices": total("active_devices"),
            "new_users": total("new_users"),
            "new_devices": total("new_devices"),
            "sessions": total("total_sessions"),
            "duration_hours": total("total_duration_h").cast("double"),
            "avg_dur_min": ratio(hundredths(minutes), total("total_sessions") * 100),
            "valid_rate": ratio(total("valid_sessions"), total("total_sessions")),
            "avg_sessions_per_user": ratio(total("total_sessions"), total("dau")),
            "dur_per_user_min": ratio(total("total_duration_sec"), total("dau") * 60),
            "power_on_cnt": total("power_on_cnt"),
            "complete_sessions": total("complete_sessions"),
            "valid_sessions": total("valid_sessions"),
        }

    every = metrics(None)
    columns = [every[name].alias(name) for name in names]
    if device_code:
        own = metrics(F.col("deviceCode") == device_code)
        columns += [own[name].alias(f"{name}_own") for name in names]
    return daily.groupBy("evt_dt").agg(*columns)


def _at(name: str, when: Column) -> Column:
    """Value on the latest day that satisfies ``when``."""
    digits = SNAPSHOT_DIGITS[name][0]
    value = F.max_by(F.col(name), F.when(when, F.col("evt_dt")))
    return value if digits is None else F.round(value, digits)


def _mean(value: Column, digits: int) -> Column:
    """Mean over days; decimal, so that half-way cases do not depend on the order of summation."""
    return F.round(F.avg(value.cast("decimal(28,12)")), digits).cast("double")


def _days_wanted(rows: DataFrame, day: str, last: Column | None, pick) -> Column:
    """The days of a table up to ``last`` that ``pick`` takes from the list of all, newest first, as a scalar subquery.

    Only the day column is read for it. Compared with a partition column, it prunes partitions when the query runs.
    """
    if last is not None:
        rows = rows.where(F.col(day) <= last)
    known = rows.agg(F.sort_array(F.collect_set(day), asc=False).alias("known"))
    return known.select(pick(F.col("known"))).scalar()


def compare_days(
    marts: Marts, end: str, device_code: str | None = None, names: list[str] | None = None
) -> DataFrame:
    """One row: each metric on the latest day <= ``end`` (``now_*``), on the latest day before ``end``
    (``prev_*``), and its mean over the days present among the seven before ``end`` (``week_*``).

    The snapshots cover all models while the mean honours the model filter. All three come out of one
    pass over a frame of one row per day, for which at most nine days of the table are read.
    """
    day, last = F.col("evt_dt"), as_date(end)

    def before(d: Column) -> Column:
        return d <= F.date_sub(last, 1)

    def week(d: Column) -> Column:
        return d.between(F.date_sub(last, 7), F.date_sub(last, 1))

    names = names or list(SNAPSHOT_DIGITS)
    wanted = _days_wanted(
        marts.daily, "evt_dt", last, lambda known: F.concat(F.slice(known, 1, 1), F.slice(F.filter(known, before), 1, 1), F.filter(known, week))
    )
    days = _day_metrics(marts.daily.where(F.array_contains(wanted, day)), device_code, names)
    suffix = "_own" if device_code else ""
    columns = []
    for name in names:
        columns.append(_at(name, F.lit(True)).alias(f"now_{name}"))
        columns.append(_at(name, before(day)).alias(f"prev_{name}"))
        mean = _mean(F.when(week(day), F.col(f"{name}{suffix}")), SNAPSHOT_DIGITS[name][1])
        columns.append(mean.alias(f"week_{name}"))
    return days.agg(*columns)


def daily_snapshot(marts: Marts, day: str) -> DataFrame:
    """All metrics of the latest day <= ``day``, over all models."""
    return _snapshot(marts, day, list(SNAPSHOT_DIGITS))


def _snapshot(marts: Marts, day: str, names: list[str]) -> DataFrame:
    newest = _days_wanted(marts.daily, "evt_dt", as_date(day), lambda known: F.slice(known, 1, 1))
    days = _day_metrics(marts.daily.where(F.array_contains(newest, F.col("evt_dt"))), None, names)
    return days.agg(*[_at(name, F.lit(True)).alias(name) for name in names])


def seven_day_mean(marts: Marts, end: str, device_code: str | None = None) -> DataFrame:
    """Mean of the daily metrics over the days present in the seven that end with ``end``."""
    last = as_date(end)
    rows = marts.daily.where(F.col("evt_dt").between(F.date_sub(last, 6), last))
    if device_code:
        rows = rows.where(F.col("deviceCode") == device_code)
    days = _day_metrics(rows, None, list(SNAPSHOT_DIGITS))
    return days.agg(*[_mean(F.col(n), digits).alias(n) for n, (_, digits) in SNAPSHOT_DIGITS.items()])


def _change(out: str, name: str, points: bool = False) -> list[Column]:
    """Deltas of the rounded values against the previous day and the seven-day mean."""
    delta = delta_pp if points else delta_pct
    now = F.col(f"now_{name}")
    return [
        delta(now, F.col(f"prev_{name}")).alias(f"{out}_d1_delta"),
        delta(now, F.col(f"week_{name}")).alias(f"{out}_d7_delta"),
    ]


RATES = ["d1_user_ret", "d7_user_ret", "d1_device_ret", "d7_device_ret"]


def _compare_rates(marts: Marts, end: str, bounded: bool, names: list[str] = RATES) -> DataFrame:
    """One row: each retention rate on the latest base day, the latest before ``end``, and the mean of
    the last seven rows before ``end``. ``bounded`` limits the latest row to base days <= ``end``.
    At most eight base days of the table are read."""
    day, last = F.col("base_dt"), as_date(end)

    def past(d: Column) -> Column:
        return d <= F.date_sub(last, 1)

    rows = marts.retention.where(F.col("deviceCode") == ALL)
    wanted = _days_wanted(
        rows, "base_dt", last if bounded else None, lambda known: F.concat(F.slice(known, 1, 1), F.slice(F.filter(known, past), 1, 7))
    )
    columns = []
    for name in names:
        columns.append(F.max_by(name, day).cast("double").alias(f"now_{name}"))
        columns.append(F.max_by(name, F.when(past(day), day)).cast("double").alias(f"prev_{name}"))
        mean = F.round(F.avg(F.when(past(day), F.col(name))), 5)
        columns.append(mean.cast("double").alias(f"week_{name}"))
    return rows.where(F.array_contains(wanted, day)).agg(*columns)


def yesterday_card(marts: Marts, end: str, device_code: str | None = None) -> DataFrame:
    """Latest day with its change against the previous day and the seven-day mean.

    The D1 rate shown is that of the newest base day in the table, even past ``end``.
    """
    names = ["dau", "active_devices", "sessions", "duration_hours", "avg_dur_min", "valid_rate"]
    days = compare_days(marts, end, device_code, names)
    both = one_row(days, _compare_rates(marts, end, bounded=False, names=["d1_user_ret"]))
    return both.select(
        *[F.col(f"now_{n}").alias(n) for n in ("dau", "active_devices", "sessions", "duration_hours", "avg_dur_min")],
        F.bround(F.col("now_d1_user_ret") * 100, 1).alias("d1_ret"),
        F.col("now_valid_rate").alias("valid_rate"),
        *_change("dau", "dau"),
        *_change("active_devices", "active_devices"),
        *_change("sessions", "sessions"),
        *_change("duration_hours", "duration_hours"),
        *_change("d1_ret", "d1_user_ret", points=True),
        *_change("valid_rate", "valid_rate", points=True),
    )


def retention_summary(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    means = in_range(marts.retention, start, end, ALL, day="base_dt").agg(
        *[F.round(F.avg(name), 5).cast("double").alias(f"avg_{name}") for name in RATES]
    )
    activity = (
        in_range(marts.daily, start, end, device_code)
        .groupBy("evt_dt")
        .agg(F.sum("dau").alias("dau"), F.sum("active_devices").alias("devices"))
        .agg(F.round(F.avg("dau"), 0).alias("avg_dau"), F.round(F.avg("devices"), 0).alias("avg_devices"))
    )
    days = compare_days(marts, end, device_code, ["dau", "new_users", "new_devices"])
    row = one_row(means, activity, days, _compare_rates(marts, end, bounded=True))
    short = {name: name.replace("_ret", "") for name in RATES}
    return row.select(
        "avg_dau",
        "avg_devices",
        *[F.col(f"now_{name}").alias(f"{s}_pct") for name, s in short.items()],
        *[F.col(f"avg_{name}").alias(f"avg_{s}_pct") for name, s in short.items()],
        F.col("now_new_users").alias("new_users_yday"),
        F.col("now_new_devices").alias("new_devices_yday"),
        *_change("dau", "dau"),
        *[c for name, s in short.items() for c in _change(s, name, points=True)],
        F.col("now_dau").alias("dau_yday"),
        *_change("new_users", "new_users"),
        *_change("new_devices", "new_devices"),
    )


# ---- sessions per user and day --------------------------------------------------------------------


def sessions_per_user_day(sessions: DataFrame) -> DataFrame:
    """(evt_dt, uid, n): a day holds each session id once, so a plain count is enough."""
    return (
        sessions.where(F.col("uid").isNotNull()).groupBy("evt_dt", "uid").agg(F.count("useSessionId").alias("n"))
    )


def sessions_summary(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Share of user-days with a single session and the largest count; over all models."""
    days = sessions_per_user_day(in_range(marts.sessions, start, end)).agg(
        ratio(F.count_if(F.col("n") == 1), F.count("*"), 4).alias("one_per_day_pct"),
        F.max("n").alias("max_sessions_single_user"),
    )
    none = F.lit(None).cast("double")
    change = compare_days(marts, end, device_code, ["sessions", "avg_sessions_per_user"])
    return one_row(days, change).select(
        "one_per_day_pct",
        "max_sessions_single_user",
        *_change("sessions", "sessions"),
        *_change("avg_sessions_per_user", "avg_sessions_per_user"),
        *[none.alias(f"{n}_{d}_delta") for n in ("max_sessions", "one_per_day") for d in ("d1", "d7")],
    )


def sessions_yesterday(marts: Marts, end: str, device_code: str | None = None) -> DataFrame:
    """The same for the latest day, its previous day and the mean of the daily shares of seven days.

    The two days are looked up in the small daily table and joined to the session table, where they
    prune all other day partitions.
    """
    last = as_date(end)
    before = F.date_sub(last, 1)
    day = F.col("evt_dt")
    days = marts.daily.where(day <= last).agg(
        F.max("evt_dt").alias("now_dt"), F.max(F.when(day <= before, day)).alias("prev_dt")
    )
    week = F.sequence(F.date_sub(last, 7), before)
    wanted = days.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("now").alias("what"), F.col("now_dt").alias("evt_dt"))),
                F.array(F.struct(F.lit("prev").alias("what"), F.col("prev_dt").alias("evt_dt"))),
                F.transform(week, lambda d: F.struct(F.lit("week").alias("what"), d.alias("evt_dt"))),
            )
        ).alias("w")
    ).select("w.*")
    sessions = marts.sessions.where(day <= last)
    if device_code:
        sessions = sessions.where(F.col("deviceCode") == device_code)
    sessions = sessions.join(wanted.where(day.isNotNull()).select("evt_dt").distinct(), "evt_dt", "left_semi")
    per_day = (
        sessions_per_user_day(sessions)
        .groupBy("evt_dt")
        .agg(F.count_if(F.col("n") == 1).alias("one"), F.count("*").alias("users"), F.max("n").alias("most"))
    )
    share = ratio(F.col("one"), F.col("users"))

    def only(what: str, value: Column) -> Column:
        return F.when(F.col("what") == what, value)

    row = wanted.join(per_day, "evt_dt", "left").agg(
        F.round(F.max(only("now", share)), 4).alias("now_one"),
        F.round(F.max(only("prev", share)), 4).alias("prev_one"),
        _mean(only("week", share), 4).alias("week_one"),
        F.max(only("now", F.col("most"))).alias("max_sessions_single_user"),
    )
    change = compare_days(marts, end, device_code, ["sessions", "avg_sessions_per_user"])
    return one_row(row, change).select(
        F.col("now_sessions").alias("total_sessions"),
        F.col("now_avg_sessions_per_user").alias("avg_sessions_per_user"),
        F.col("now_one").alias("one_per_day_pct"),
        "max_sessions_single_user",
        *_change("sessions", "sessions"),
        *_change("avg_sessions_per_user", "avg_sessions_per_user"),
        *_change("one_per_day", "one", points=True),
    )


# ---- durations ------------------------------------------------------------------------------------


def duration_summary(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Totals of the range; minutes per user are divided by the number of days once more."""
    totals = in_range(marts.daily, start, end, device_code).agg(
        F.sum("total_duration_h").cast("double").alias("total_duration_hours"),
        weighted_mean(F.col("avg_duration_min"), F.col("total_sessions"), 2).alias("avg_duration_min"),
        ratio(F.sum("total_duration_sec"), F.sum("dau") * F.countDistinct("evt_dt") * 60, 2).alias("daily_min_per_user"),
        ratio(F.sum("valid_sessions"), F.sum("total_sessions"), 5).alias("valid_session_rate_pct"),
    )
    names = ["duration_hours", "avg_dur_min", "dur_per_user_min", "valid_rate"]
    return one_row(totals, compare_days(marts, end, device_code, names)).select(
        *totals.columns,
        *_change("total_hours", "duration_hours"),
        *_change("avg_dur_min", "avg_dur_min"),
        *_change("dur_per_user", "dur_per_user_min"),
        *_change("valid_rate", "valid_rate", points=True),
    )


def duration_yesterday(marts: Marts, end: str) -> DataFrame:
    """Duration metrics of the latest day <= ``end``, over all models."""
    row = _snapshot(marts, end, ["duration_hours", "avg_dur_min", "dur_per_user_min", "valid_rate"])
    return row.select(
        F.col("duration_hours").alias("total_hours_yday"),
        F.col("avg_dur_min").alias("avg_dur_min_yday"),
        F.col("dur_per_user_min").alias("daily_per_user_yday"),
        F.col("valid_rate").alias("valid_rate_yday"),
    )


# ---- habits ---------------------------------------------------------------------------------------


def adjust_summary(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Share of sessions with a mode or level change, and changes per session.

    Rows are folded per session id first; then plain sums replace three distinct counts over the facts.
    """
    per_session = in_range(marts.sessions, start, end, device_code).groupBy("useSessionId").agg(
        F.sum("mode_adj_cnt").alias("mode"),
        F.sum("level_adj_cnt").alias("level"),
        F.max("mode_adj_cnt").alias("most_mode"),
        F.max("level_adj_cnt").alias("most_level"),
    )
    sessions, known = F.count("useSessionId"), F.col("useSessionId").isNotNull()

    def rate(most: str) -> Column:
        return F.bround(ratio(F.count_if(known & (F.col(most) > 0)), sessions) * 100, 1)

    return per_session.agg(
        rate("most_mode").alias("mode_adj_rate_pct"),
        rate("most_level").alias("level_adj_rate_pct"),
        ratio(F.sum("mode"), sessions, 2).alias("avg_mode_adj"),
        ratio(F.sum("level"), sessions, 2).alias("avg_level_adj"),
    )


def pause_stats(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    """Pause rate, mean pauses of paused sessions and the 0/1/2/3+ distribution, one row per bucket."""
    n = F.col("pause_cnt")
    row = in_range(marts.sessions, start, end, device_code).where(n.isNotNull()).agg(
        F.count("useSessionId").alias("total"),
        F.count_if(n > 0).alias("paused"),
        F.sum(n).alias("pauses"),
        *[F.count_if(n == i).alias(str(i)) for i in range(3)],
        F.count_if(n >= 3).alias("3+"),
    )
    row = row.withColumn("pause_rate_pct", ratio(F.col("paused") * 100, F.col("total"), 1)).withColumn(
        "avg_pauses", ratio(F.col("pauses"), F.col("paused"), 1)
    )
    long = row.unpivot(["pause_rate_pct", "avg_pauses", "total"], ["0", "1", "2", "3+"], "pauses", "cnt")
    # An empty range divides by one, as the published report does.
    base = F.greatest(F.col("total"), F.lit(1))
    share = F.bround(ratio(F.col("cnt"), base) * 100, 1)
    return long.select("pauses", "pause_rate_pct", "avg_pauses", share.alias("pct"))
