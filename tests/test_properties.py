"""Identities that hold between reports over the same range."""

import pytest
from pyspark.sql import functions as F

from checks.params import END, START
from checks.store import TestMarts
from tidemark.operators import distributions as dist, kpi, trends
from tidemark.plans.daily import cumulative
from tidemark.plans.retention import build_retention

SF_DIR = "/root/testdata/sf0.001"
SPAN = (START, END)


@pytest.fixture(scope="module")
def marts(spark):
    return TestMarts(spark, SF_DIR).marts("sessions", "session_modes", "daily", "retention", "events")


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_bucket_totals(marts):
    complete = marts.sessions.where(F.col("evt_dt").between(*SPAN) & (F.col("is_complete") == 1)).count()
    for report in (dist.final_modes, dist.suction_levels, dist.modes_used, dist.duration_buckets, dist.mode_by_level):
        assert total(report(marts, *SPAN), "session_count") == complete
    users = marts.sessions.agg(F.countDistinct("uid")).first()[0]
    assert total(dist.streaks(marts), "user_count") == users
    days = marts.sessions.where(F.col("evt_dt").between(*SPAN)).select("uid", "evt_dt").dropna().distinct().count()
    assert total(dist.user_day_buckets(marts, *SPAN), "user_day_count") == days
    assert total(trends.user_day_bucket_trend(marts, *SPAN), "cnt_of_day") == days


def test_shares_sum_to_one(marts):
    for df, by in (
        (dist.final_modes(marts, *SPAN), None),
        (dist.user_totals(marts, *SPAN), None),
        (dist.hours_by_day_type(marts, *SPAN), "day_type"),
        (trends.mode_minutes_trend(marts, *SPAN), "dt"),
        (dist.adjusts_per_session(marts, *SPAN), "kind"),
    ):
        sums = df.groupBy(by).agg(F.sum("pct")) if by else df.agg(F.lit(1), F.sum("pct"))
        assert all(abs(r[1] - 1) < 1e-3 for r in sums.collect())


def test_funnel_order(marts):
    bad = marts.daily.where("complete_sessions > total_sessions OR valid_sessions > complete_sessions")
    assert bad.count() == 0
    row = kpi.funnel_totals(marts, *SPAN).first()
    assert row["valid_sessions"] <= row["ended_sessions"] <= row["started_sessions"]
    assert total(dist.duration_buckets(marts, *SPAN), "session_count") == row["ended_sessions"]


def test_cumulative_totals(marts):
    last = cumulative(marts.sessions).groupBy("deviceCode").agg(
        F.max("cumulative_users"), F.max_by("cumulative_users", "evt_dt"), F.max("cumulative_sessions")
    )
    truth = marts.sessions.groupBy("deviceCode").agg(F.countDistinct("uid"), F.countDistinct("useSessionId"))
    expected = {r[0]: (r[1], r[1], r[2]) for r in truth.collect()}
    assert {r[0]: (r[1], r[2], r[3]) for r in last.collect()} == expected


def test_retention_bounds(marts):
    rates = [c for c in marts.retention.columns if c.endswith("_ret")]
    bad = " OR ".join(f"{c} < 0 OR {c} > 1" for c in rates)
    assert marts.retention.where(bad).count() == 0


def test_retention_by_window_equals_whole(spark, marts):
    parts = build_retention(marts.sessions, "2024-01-01", "2024-01-12").union(
        build_retention(marts.sessions, "2024-01-13", "2024-01-30")
    )
    assert parts.exceptAll(marts.retention).count() == 0 and parts.count() == 30


def test_paths_and_level_counts(marts):
    s = marts.sessions
    steps = F.when(F.col("mode_adj_path").isNull(), 0).otherwise(F.size(F.split("mode_adj_path", ",")))
    assert s.where(steps != F.col("mode_adj_cnt")).count() == 0
    assert s.where("level_up_cnt + level_down_cnt > level_adj_cnt").count() == 0
    modes = marts.session_modes.groupBy("evt_dt", "useSessionId").agg(F.sum("duration_sec").alias("sec"))
    both = modes.join(s, ["evt_dt", "useSessionId"], "full").where("NOT (sec <=> total_duration_sec)")
    assert both.count() == 0
