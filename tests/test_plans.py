"""Shape of the physical plans: no pairwise joins, no Python, pruned and filtered scans."""

import re

import pytest

from checks.params import END, START
from checks.registry import QUERIES
from checks.store import TestMarts
from tidemark.operators import distributions as dist, firmware, kpi, trends, userflags
from tidemark.operators.userflags import UserFilter
from tidemark.plans.events import latest_events
from tidemark.plans.sessions import build_sessions

SF_DIR = "/root/testdata/sf0.001"
SPAN = (START, END)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return TestMarts(spark, SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("NestedLoop", "Cartesian", "Python"):
        assert word not in text


def test_day_range_prunes_partitions_and_columns(tables):
    text = plan(dist.final_modes(tables.marts("sessions"), *SPAN, "D1"))
    assert re.search(r"PartitionFilters: \[.*evt_dt.*>= 2024-01-03.*<= 2024-01-28", text)
    assert "EqualTo(deviceCode,D1)" in text and "IsNotNull(finalModeType)" in text
    assert "ReadSchema: struct<useSessionId:string,deviceCode:string,finalModeType:string>" in text


def test_one_scan_per_report(tables):
    m = tables.marts("sessions", "daily", "events")
    for df in (
        dist.level_directions(m, *SPAN),
        dist.adjusts_per_session(m, *SPAN),
        dist.weekly_cohorts(m, *SPAN),
        dist.streaks(m),
        kpi.pause_stats(m, *SPAN),
        kpi.adjust_summary(m, *SPAN),
        build_sessions(m.events),
        firmware.filter_options(tables.devices),
        userflags.overview(tables.user_flags, UserFilter(), "2001-08-01"),
    ):
        assert plan(df).count("FileScan") == 1


def test_counts_fold_before_the_shuffle(tables):
    m = tables.marts("sessions", "events")
    assert "partial_collect_set" in plan(dist.streaks(m))
    assert "partial_count(useSessionId" in plan(trends.user_day_bucket_trend(m, *SPAN))
    assert re.search(r"WindowGroupLimit .*Partial", plan(latest_events(m.events)))
    # Two steps by session: the first one also spreads a session over its hours.
    text = plan(build_sessions(m.events))
    assert len(re.findall(r"Exchange hashpartitioning\(useSessionId#\d+, evt_dt#\d+, ", text)) == 1
    assert text.count("Exchange") == 2


def test_device_filters_reach_the_scan(tables):
    text = plan(firmware.version_trend(tables.devices, "2024-01-30", model="click", status="bound"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(create_time" in pushed and "EqualTo(model,click)" in pushed and "EqualTo(status,2)" in pushed
    text = plan(userflags.daily_users(tables.user_flags, UserFilter(date_from="2000-01-01"), "2001-08-01"))
    assert "GreaterThanOrEqual(event_date,2000-01-01)" in text


def test_latest_day_prunes_the_session_table(tables):
    text = plan(kpi.sessions_yesterday(tables.marts("sessions", "daily"), END))
    assert "dynamicpruning" in text


def test_as_of_reports_read_the_days_they_show(tables):
    m = tables.marts("daily", "retention")
    for df in (kpi.compare_days(m, END), kpi.daily_snapshot(m, END)):
        scans = re.findall(r"FileScan .*", plan(df))
        assert len(scans) == 2
        pruned = [s for s in scans if re.search(r"PartitionFilters: \[.*(scalar-)?subquery", s, re.I)]
        index = [s for s in scans if "ReadSchema: struct<>" in s]  # day folders only
        assert len(pruned) == len(index) == 1 and pruned != index
    for df in (kpi.yesterday_card(m, END), kpi.retention_summary(m, *SPAN)):
        scans = [s for s in re.findall(r"FileScan .*", plan(df)) if "PartitionFilters: []" in s]
        assert all("ReadSchema: struct<>" in s or "ReadSchema: struct<deviceCode:string>" in s for s in scans)


def test_version_matrix_reads_the_devices_twice(tables):
    trend = firmware.version_trend(tables.devices, "2024-01-30")
    for df in (firmware.zero_filled(trend, "2024-01-30"), firmware.version_matrix(trend, "2024-01-30", ["1", "2"])):
        assert "Join" not in plan(df)
        main = [line for line in plan(df).split("Subquery")[0].splitlines() if "FileScan" in line]
        assert len(main) <= 1
        df.collect()  # the dates are found once, whatever the number of their uses
        assert "ReusedSubquery" in plan(df)
    assert "Exchange" not in plan(firmware.device_details(tables.devices))
