"""Report rules on hand-made marts: NULLs, bucket edges, ties, empty ranges, rounded inputs."""

import datetime as dt

import pytest
from helpers import frame, rows, session
from tidemark.functions import buckets as b
from tidemark.functions.measures import delta_pct, delta_pp
from tidemark.marts import Marts
from tidemark.operators import distributions as dist, firmware, kpi, shaping, trends, userflags
from tidemark.operators.userflags import UserFilter
from tidemark.plans.daily import build_daily, cumulative
from tidemark.plans.retention import build_retention
from tidemark.plans.sections import SECTIONS, run_section, run_user_dashboard
from pyspark.sql import functions as F

D = dt.date.fromisoformat
RANGE = ("2024-01-01", "2024-01-31")


def days(uid, *numbers, month="01", **extra):
    return [session(f"{uid}{month}{n}", f"2024-{month}-{n:02d}", uid, **extra) for n in numbers]


def test_unknown_user_in_retention(spark):
    rows_ = [session(i, "2024-01-01", u) for i, u in enumerate(["a", "b", None])]
    rows_ += [session(10 + i, "2024-01-02", u) for i, u in enumerate(["a", None])]
    s = frame(spark, "sessions", rows_)
    cols = ("base_users", "d1_retained_users", "base_devices", "d1_retained_devices", "new_users_base")
    got = build_retention(s, "2024-01-02", "2024-01-02").select(*cols).collect()
    assert [tuple(r) for r in got] == [(3, 1, 2, 1, 0)]
    got = build_retention(s, "2024-01-02", "2024-01-02", drop_null_uid=True).select(*cols).collect()
    assert [tuple(r) for r in got] == [(2, 1, 2, 1, 0)]
    first = build_retention(s, "2024-01-01", "2024-01-01").select("new_users_base", "cohort_d1_ret").collect()[0]
    assert (first[0], float(first[1])) == (3, 0.33333)  # the unknown user is new once, never back


def test_retention_days_without_data(spark):
    s = frame(spark, "sessions", days("a", 1, 8, 15))
    got = build_retention(s, "2024-01-05", "2024-01-16").orderBy("base_dt").collect()
    assert [r["base_dt"] for r in got] == [D("2024-01-05") + dt.timedelta(i) for i in range(12)]
    by_day = {r["base_dt"].day: r for r in got}
    assert (by_day[8]["d7_retained_users"], float(by_day[8]["d7_user_ret"])) == (1, 1.0)
    assert (by_day[15]["d7_retained_users"], by_day[15]["d14_retained_users"]) == (1, 1)
    assert by_day[9]["base_users"] == 1 and by_day[9]["d1_retained_users"] == 0
    assert by_day[7]["d1_user_ret"] is None


def test_streaks(spark):
    data = days("one", 5) + days("gap", 1, 2, 4) + days("gap", 2) + days("long", *range(1, 32))
    data += days("long", 1, 2, month="02") + days("two", 10, 11, 20, 21, 22, 23) + [session(99, "2024-01-01", None)]
    got = rows(dist.streaks(Marts(sessions=frame(spark, "sessions", data))), "streak_bucket", "user_count", "pct")
    assert got == [("1 day", 1, 0.25), ("2-3 days", 1, 0.25), ("30+ days", 1, 0.25), ("4-7 days", 1, 0.25)]


@pytest.mark.parametrize(
    "value,order",
    [(0, 1), (299, 1), (300, 2), (599, 2), (600, 3), (601, 3), (2699, 9), (2700, 10), (3600, 10), (3601, 10)],
)
def test_duration_edges(spark, value, order):
    assert spark.range(1).select(b.bucket_order(F.lit(value), b.DURATION_SEC)).first()[0] == order


def test_bucket_edges(spark):
    levels = ["0", "1", "3", "4", "6", "7", "9", "10", "x", ""]
    df = spark.createDataFrame([(v,) for v in levels], "v string")
    got = [r[0] for r in df.select(b.bucket_label(b.suction_level(F.col("v")), b.SUCTION_LEVEL)).collect()]
    assert got == ["9+", "1-3", "1-3", "4-6", "4-6", "7-9", "7-9", "9+", "9+", "9+"]
    totals = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 10, 11, 20, 21, 50, 51, 100, 101)], "v int")
    got = [r[0] for r in totals.select(b.bucket_order(F.col("v"), b.SESSIONS_IN_TOTAL)).collect()]
    assert got == [1, 2, 2, 6, 6, 11, 11, 21, 21, 51, 51, 101]
    per_day = spark.createDataFrame([(n,) for n in (1, 5, 6, 10, 11, 20, 21)], "v int")
    assert [r[0] for r in per_day.select(b.bucket_label(F.col("v"), b.SESSIONS_PER_DAY)).collect()] == [
        "1", "5", "6-10", "6-10", "11-20", "11-20", "21+",
    ]
    assert [r[0] for r in per_day.select(b.bucket_label(F.col("v"), b.SESSIONS_PER_DAY_SHORT)).collect()] == [
        "1", "4-5", "6+", "6+", "6+", "6+", "6+",
    ]
    used = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 9)], "v int")
    assert [r[0] for r in used.select(b.bucket_order(F.col("v"), b.MODES_USED)).collect()] == [4, 1, 2, 3, 3]


def test_top_hours_tie_and_share(spark):
    data = [session(h, "2024-01-01", local_hour=h) for h in range(7)]
    got = dist.top_hours(Marts(sessions=frame(spark, "sessions", data)), *RANGE).collect()
    assert [r["local_hour"] for r in got] == [0, 1, 2, 3, 4, 5]  # equal counts: earlier hour first
    assert got[0]["pct"] == 0.14286  # of all seven hours


def test_session_id_on_two_days_counts_once(spark):
    data = [session("s", "2024-01-01", finalModeType="x"), session("s", "2024-01-02", finalModeType="x")]
    marts = Marts(sessions=frame(spark, "sessions", data))
    assert rows(dist.final_modes(marts, *RANGE), "session_count") == [(1,)]
    assert rows(dist.user_totals(marts, *RANGE), "cumulative_bucket") == [("1",)]
    assert rows(dist.user_day_buckets(marts, *RANGE), "session_bucket", "user_day_count") == [("1", 2)]


def test_weekday_flag(spark):
    data = [session(i, "2024-01-06", local_hour=1, is_weekday=w) for i, w in enumerate([1, 0, None])]
    data.append(session(9, "2031-01-01", local_hour=1, is_weekday=1))
    marts = Marts(sessions=frame(spark, "sessions", data))
    stored = rows(dist.hours_by_day_type(marts, "2024-01-01", "2031-12-31"), "day_type", "session_count", "pct")
    assert stored == [("weekday", 2, 1.0), ("weekend", 1, 1.0), ("weekend", 1, 1.0)]  # share per raw flag value
    by_date = dist.hours_by_day_type(marts, "2024-01-01", "2031-12-31", weekday_source="evt_dt")
    assert rows(by_date, "day_type", "session_count") == [("weekend", 3)]


def test_adjusts_and_directions(spark):
    data = [
        session(i, "2024-01-01", level_adj_cnt=n, level_up_cnt=u, level_down_cnt=d, mode_adj_cnt=m)
        for i, (n, u, d, m) in enumerate([(10, 4, 3, 0), (12, 5, 5, 1), (9, 0, 0, None), (None, None, None, 2)])
    ]
    marts = Marts(sessions=frame(spark, "sessions", data))
    assert rows(dist.level_directions(marts, *RANGE), "direction", "adjust_count", "pct") == [
        ("down", 8, 0.2581), ("same", 14, 0.4516), ("up", 9, 0.2903),
    ]
    got = rows(dist.adjusts_per_session(marts, *RANGE), "kind", "adj_bucket", "bucket_order", "session_count")
    assert ("level", "10+", 10, 2) in got and ("level", None, None, 1) in got and ("mode", None, None, 1) in got
    row = kpi.adjust_summary(marts, *RANGE).first()
    assert tuple(row) == (50.0, 75.0, 0.75, 7.75)


def test_empty_range(spark):
    marts = Marts(
        sessions=frame(spark, "sessions", []),
        session_modes=frame(spark, "session_modes", []),
        daily=frame(spark, "daily", []),
        retention=frame(spark, "retention", []),
        events=frame(spark, "events", []),
        devices=frame(spark, "devices", []),
    )
    assert [r["pct"] for r in kpi.pause_stats(marts, *RANGE).collect()] == [0.0] * 4
    assert rows(dist.level_directions(marts, *RANGE), "adjust_count", "pct") == [(None, None)] * 3
    row = kpi.yesterday_card(marts, "2024-01-10").first()
    assert set(row) == {None}
    assert tuple(kpi.funnel_rates(marts, *RANGE).first()) == (0, 0, 0, 0, None, None, None)
    for section in SECTIONS:
        for df in run_section(marts, section, *RANGE).values():
            df.collect()
    with pytest.raises(ValueError):
        run_section(marts, "nonsense", *RANGE)


def daily_row(day, code="D1", **extra):
    row = {
        "evt_dt": day, "deviceCode": code, "dau": 10, "active_devices": 10, "new_users": 1, "new_devices": 1,
        "total_sessions": 20, "complete_sessions": 10, "valid_sessions": 5, "power_on_cnt": 30, "total_duration_sec": 6000,
        "total_duration_h": "1.67", "avg_duration_min": "5.00", "cumulative_users": 100, "cumulative_devices": 120,
    }
    return {**row, **extra}


def test_comparison_uses_days_present_and_rounded_values(spark):
    data = [daily_row("2024-01-10", dau=30), daily_row("2024-01-08", dau=20), daily_row("2024-01-05", dau=25)]
    data += [daily_row("2024-01-10", "D2", dau=7), daily_row("2024-01-02", dau=999)]
    marts = Marts(daily=frame(spark, "daily", data))
    row = kpi.compare_days(marts, "2024-01-12").first()
    assert (row["now_dau"], row["prev_dau"]) == (37, 37)  # no data on the 11th and 12th: both see the 10th
    assert row["week_dau"] == 27.0  # (37 + 20 + 25) / 3 days present, rounded
    own = kpi.compare_days(marts, "2024-01-12", "D1").first()
    assert (own["now_dau"], own["week_dau"]) == (37, 25.0)  # only the mean honours the model
    card = kpi.compare_days(marts, "2024-01-10").first()
    assert (card["now_dau"], card["prev_dau"], card["week_dau"]) == (37, 20, 23.0)
    week = kpi.seven_day_mean(marts, "2024-01-10").first()
    assert week["dau"] == 27.0


def test_deltas(spark):
    df = spark.createDataFrame([(37.0, 23.0), (1.0, 0.0), (None, 1.0), (1.0, None), (-1.0, -2.0)], "n double, o double")
    got = [tuple(r) for r in df.select(delta_pct(F.col("n"), F.col("o")), delta_pp(F.col("n"), F.col("o"))).collect()]
    assert got == [(60.9, 1400.0), (None, 100.0), (None, None), (None, None), (50.0, 100.0)]


def test_zero_base(spark):
    data = [daily_row("2024-01-01", dau=0, total_sessions=0, power_on_cnt=0)]
    marts = Marts(daily=frame(spark, "daily", data))
    assert rows(trends.sessions_per_user_trend(marts, *RANGE), "avg_sessions") == [(None,)]
    assert kpi.funnel_rates(marts, *RANGE).first()["start_rate_pct"] is None


def test_newest_retention_row_may_lie_after_the_end(spark):
    data = [
        {"base_dt": f"2024-01-{n:02d}", "deviceCode": "ALL", "d1_user_ret": f"0.{n:02d}000"} for n in range(1, 21)
    ] + [{"base_dt": "2024-01-25", "deviceCode": "D1", "d1_user_ret": "0.99000"}]
    marts = Marts(retention=frame(spark, "retention", data), daily=frame(spark, "daily", [daily_row("2024-01-10")]))
    card = kpi.yesterday_card(marts, "2024-01-10").first()
    assert card["d1_ret"] == 20.0  # newest row, not the one of the 10th
    assert card["d1_ret_d1_delta"] == 11.0 and card["d1_ret_d7_delta"] == 14.0  # vs the 9th, vs the 3rd..9th
    summary = kpi.retention_summary(marts, "2024-01-01", "2024-01-10").first()
    assert summary["d1_user_pct"] == 0.1 and summary["avg_d1_user_pct"] == 0.055


def test_daily_totals_with_unknown_model(spark):
    data = [
        session("s1", "2024-01-01", "a"),
        session("s2", "2024-01-01", "b", deviceCode="D2"),
        session("s3", "2024-01-02", "a", deviceCode=None),
        session("s4", "2024-01-03", "c", deviceCode=None),
        session("s4", "2024-01-04", "c", deviceCode=None),
        session("s5", "2024-01-04", "a", deviceCode="D2"),
        session("s6", "2024-01-04", None),
    ]
    s = frame(spark, "sessions", data)
    power = [{"id": i, "dt": "2024-01-04", "evt_dt": "2024-01-04", "eventName": "pump_startup_evt", "deviceCode": c}
             for i, c in enumerate(["D1", "D1", None])]
    cols = ("evt_dt", "deviceCode", "cumulative_users", "cumulative_sessions", "new_users", "power_on_cnt", "dau")
    e = frame(spark, "events", power)
    got = {(r[0].day, r[1]): tuple(r)[2:] for r in build_daily(s, e).select(*cols).collect()}
    assert got == {
        (1, "D1"): (1, 1, 1, 0, 1),
        (1, "D2"): (1, 1, 1, 0, 1),
        (2, None): (2, 3, 0, 0, 1),  # over all models: a and b
        (3, None): (3, 4, 1, 0, 1),
        (4, None): (3, 6, 0, 3, 1),  # s4 counts once, s6 has no user
        (4, "D1"): (1, 2, 0, 3, 0),
        (4, "D2"): (2, 2, 0, 3, 1),  # a is new to D2 but not new at all
    }
    own = build_daily(s, e, power_on_by_model=True)
    by_model = {(r[0].day, r[1]): r[2] for r in own.select("evt_dt", "deviceCode", "power_on_cnt").collect()}
    assert by_model[(4, "D1")] == 2 and by_model[(4, None)] == 1 and by_model[(4, "D2")] == 0
    assert cumulative(s).count() == 7


def test_weekly_cohort_rules(spark):
    data = days("a", 1, 2, 8) + days("b", 3, 4, 17) + days("late", 31) + days("late", 1, 3, month="02")
    data.append(session("n", "2024-01-01", None))
    marts = Marts(sessions=frame(spark, "sessions", data))
    got = rows(dist.weekly_cohorts(marts, *RANGE), "install_week", "new_users", "d1_pct", "d3_pct", "d7_pct", "d14_pct")
    assert got == [(D("2024-01-01"), 2, 1.0, 0.0, 0.5, 0.5), (D("2024-01-29"), 1, 1.0, 1.0, 0.0, 0.0)]


def test_mode_reports(spark):
    def mode(sid, day, kind, sec):
        return {"evt_dt": day, "useSessionId": sid, "uid": "a", "deviceCode": "D1", "modeType": kind, "duration_sec": sec}

    data = [mode("s", "2024-01-01", "x", 3600), mode("t", "2024-01-01", "x", 3601), mode("s", "2024-01-02", "y", 60)]
    marts = Marts(
        session_modes=frame(spark, "session_modes", data),
        daily=frame(spark, "daily", [daily_row("2024-01-01", dau=4), daily_row("2024-01-03", dau=50)]),
    )
    assert rows(dist.mode_minutes(marts, *RANGE), "mode_type", "duration_min") == [("x", 120.02), ("y", 1.0)]
    hour = {"longest_sec": 3600}
    assert rows(dist.mode_minutes(marts, *RANGE, **hour), "mode_type", "duration_min") == [("x", 60.0), ("y", 1.0)]
    means = rows(dist.mode_minutes_per_session(marts, *RANGE), "mode_type", "avg_dur_per_sess_min")
    assert means == [("x", 60.01), ("y", 1.0)]
    means = rows(dist.mode_minutes_per_session(marts, *RANGE, **hour), "mode_type", "avg_dur_per_sess_min")
    assert means == [("x", 60.0), ("y", 1.0)]
    assert rows(trends.mode_minutes_trend(marts, *RANGE), "mode_type", "dur_min", "pct") == [("x", 120.02, 1.0), ("y", 1.0, 1.0)]
    assert rows(dist.mode_sessions_per_user(marts, *RANGE), "mode_type", "avg_sess_per_user") == [("x", 0.5)]


def test_model_choice(spark):
    data = [daily_row("2024-01-01", c) for c in ("B", "A", "ALL", None, "A")]
    assert [r[0] for r in kpi.device_codes(Marts(daily=frame(spark, "daily", data))).collect()] == ["A", "B"]


# ---- user flags -----------------------------------------------------------------------------------


def test_filter_days():
    assert UserFilter(date_days="7").days() == 7 and not UserFilter().has_date
    assert UserFilter(date_days="-3").days() == 0 and UserFilter(date_days="x").days() == 0 and UserFilter(date_days="x").has_date


def test_filter_rules(spark):
    data = [{"uid": str(i), "event_date": d, "active_status": "1"} for i, d in enumerate(["2024-01-01", "2024-01-20", "", None])]
    users = frame(spark, "user_flags", data)

    def ids(**given):
        return [r[0] for r in rows(userflags.apply_filter(users, UserFilter(**given), "2024-01-21"), "uid")]

    assert ids(date_days="5") == ["1"]
    assert ids(date_days="5", date_from="2024-01-01") == ["0", "1"]  # an explicit range wins
    assert ids(date_to="2024-01-05") == ["0", "2"]  # '' sorts before any date
    assert ids(date_days="bad") == ids(date_days="0") == ids(active_status="7") == ["0", "1", "2", "3"]
    row = userflags.overview(users, UserFilter(date_days="bad"), "2024-01-21").first()
    assert (row["total_users"], row["active_users"]) == (4, 2)  # any date input lifts the 30-day default
    frames = run_user_dashboard(Marts(user_flags=users), UserFilter(date_days="5"), "2024-01-21")
    assert frames["overview"].first()["total_users"] == 1 and frames["daily_trend"].count() == 1


# ---- firmware and shaping -------------------------------------------------------------------------


def device(i, version, day="2024-01-20", **extra):
    info = '{"romVersion": %s}' % version if version is not None else None
    return {"device_id": f"device-{i:06d}", "device_info": info, "status": 2, "model": "m", "data_source": "EC",
            "create_time": f"{day}T10:00:00", **extra}


def test_versions(spark):
    texts = ['"2"', '"10"', '"1.5"', '"beta"', '"null"', "null", None]
    data = [device(i, v) for i, v in enumerate(texts)] + [device(8, '"2"', status=1), device(9, '"7"', "2023-12-01")]
    devices = frame(spark, "devices", data)
    options = [tuple(r) for r in firmware.filter_options(devices).orderBy("option", "rank").collect()]
    assert [v for o, _, v in options if o == "version"] == ["1.5", "2", "7", "10", "beta"]
    assert [v for o, _, v in options if o == "status"] == ["bound", "unbound"]
    trend = firmware.version_trend(devices, "2024-01-21")
    assert rows(trend, "version", "devices") == [("1.5", 1), ("10", 1), ("2", 2), ("beta", 1)]
    bound = firmware.version_distribution(devices, "bound")
    assert ("2", 1, 20.0) in [tuple(r) for r in bound.collect()]
    domain = firmware.version_domain(bound, firmware.version_distribution(devices, "unbound"))
    assert [r[0] for r in domain.collect()] == ["1.5", "2", "7", "10", "beta"]


def test_versions_are_not_capped(spark):
    devices = frame(spark, "devices", [device(i, f'"{i}"') for i in range(250)])
    got = [r["value"] for r in firmware.filter_options(devices).where("option = 'version'").orderBy("rank").collect()]
    assert got == [str(i) for i in range(250)]


def test_zero_filled_matrix(spark):
    trend = spark.createDataFrame(
        [(D("2024-01-20"), "2", 5), (D("2024-01-21"), "10", 3), (D("2023-01-01"), "9", 1), (D("2024-01-21"), "null", 9)],
        "create_date date, version string, devices long",
    )
    got = [(r[0].day, r[1], r[2]) for r in firmware.zero_filled(trend, "2024-01-25").collect()]
    assert got == [(20, "2", 5), (20, "10", 0), (21, "2", 0), (21, "10", 3)]
    assert firmware.zero_filled(trend, "2025-01-25").count() == 9  # nothing recent: everything


def test_device_details(spark):
    data = [device(i, '"1"') for i in range(2100)] + [device(5000, None, status=1, data_source="ZZ"), device(5001, None, status=3)]
    devices = frame(spark, "devices", data)
    assert firmware.device_details(devices).count() == 2102
    assert firmware.device_details(devices, rows=2000).count() == 2000
    got = rows(firmware.device_details(devices, region="ZZ"), "id_suffix", "status", "region", "version")
    assert got == [("e-005000", "unbound", "other", None)]
    assert rows(firmware.device_details(devices, status="3"), "status") == [("3",)]


def test_shaping(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", None), ("d", 0.1), ("e", 0.05), ("f", 0.03), ("g", 0.02)], "l string, p double")
    got = [tuple(r) for r in shaping.percent_bars(df, "p", ["l"]).select("l", "bar_value", "bar_width").collect()]
    assert got[:3] == [("a", 50.0, 100), ("b", 30.0, 60), ("c", 0.0, 0)] and len(got) == 6
    small = spark.createDataFrame([("a", 0.004)], "l string, p double")
    assert shaping.percent_bars(small, "p", ["l"]).first()["bar_width"] == 40  # the scale is at least 1 percent
    zero = spark.createDataFrame([("a", 0.0), ("b", None)], "l string, p double")
    assert [r["pct"] for r in shaping.shares(zero, "p").collect()] == [0.0, 0.0]
    assert [r["bar_width"] for r in shaping.number_bars(zero, "p", ["l"]).collect()] == [0, 0]


def test_zero_filled_dates_without_version(spark):
    trend = spark.createDataFrame([(D("2024-01-20"), "1", 3), (D("2024-01-21"), None, 2)], "create_date date, version string, devices long")
    got = [(r[0].day, r[1], r[2]) for r in firmware.zero_filled(trend, "2024-01-25").collect()]
    assert got == [(20, "1", 3), (21, "1", 0)]


def test_version_matrix_with_a_column_per_version(spark):
    trend = spark.createDataFrame(
        [(D("2024-01-20"), "2.0", 5), (D("2024-01-21"), " 10", 3), (D("2024-01-21"), None, 9), (D("2024-01-22"), "x", 4), (D("2023-01-01"), "2.0", 1)],
        "create_date date, version string, devices long",
    )
    wide = firmware.version_matrix(trend, "2024-01-25", ["2.0", "10", "none"])
    assert wide.columns == ["create_date", "2.0", "10", "none"]
    assert [(r[0].day, *r[1:]) for r in wide.collect()] == [(20, 5, 0, 0), (21, 0, 3, 0), (22, 0, 0, 0)]
    assert firmware.version_matrix(trend, "2025-01-25", ["2.0"]).count() == 4  # nothing recent: everything
    nothing = trend.where("false")
    assert firmware.version_matrix(nothing, "2024-01-25", ["1"]).count() == firmware.zero_filled(nothing, "2024-01-25").count() == 0


def test_as_of_days_with_gaps(spark):
    daily = [{"evt_dt": d, "deviceCode": "D1", "dau": n} for d, n in (("2023-06-01", 7), ("2024-01-01", 5), ("2024-01-20", 3), ("2024-02-01", 9))]
    retention = [{"base_dt": f"2024-01-{n:02d}", "deviceCode": "ALL", "d1_user_ret": n / 100} for n in range(1, 21)]
    retention.append({"base_dt": "2024-01-15", "deviceCode": "D1", "d1_user_ret": 0.99})
    marts = Marts(daily=frame(spark, "daily", daily), retention=frame(spark, "retention", retention))
    row = kpi.compare_days(marts, "2024-01-20", names=["dau"]).first()
    assert (row["now_dau"], row["prev_dau"], row["week_dau"]) == (3, 5, None)  # the day before is weeks ago
    assert kpi.compare_days(marts, "2024-01-25", names=["dau"]).first()["week_dau"] == 3.0
    assert kpi.daily_snapshot(marts, "2023-12-31").first()["dau"] == 7
    assert kpi.daily_snapshot(marts, "2020-01-01").first()["dau"] is None
    # The newest base day past the end, the day before the end, the last seven before it.
    card = kpi.yesterday_card(marts, "2024-01-15").first()
    assert card["d1_ret"] == 20.0 and card["d1_ret_d1_delta"] is not None
    rates = kpi._compare_rates(marts, "2024-01-15", bounded=True, names=["d1_user_ret"]).first()
    assert tuple(rates) == (0.15, 0.14, 0.11)


def test_bars_of_all_rows(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(20)], "l string, p double")
    assert shaping.percent_bars(df, "p", ["l"], is_ratio=False, top=None).count() == 20
    assert shaping.number_bars(df, "p", ["l"]).count() == 20
    assert [r["bar_width"] for r in shaping.number_bars(df, "p", ["p"], top=2).collect()] == [0, 5]
