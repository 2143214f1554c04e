"""Reports from the roll-up mart: equal to those from sessions for any range and model, and without a scan of them."""

import pytest
from helpers import frame
from test_state import content, day, sessions_log

from checks.registry import SECTION_TABLES
from checks.store import TestMarts
from tidemark import schemas
from tidemark.marts import Marts
from tidemark.operators import distributions as dist, kpi, rollups, trends
from tidemark.plans.events import explode_events
from tidemark.plans.rollups import session_rollups
from tidemark.plans.sections import run_section
from tidemark.plans.sessions import build_session_modes, build_sessions

SF_DIR = "/root/testdata/sf0.001"
REPORTS = {
    dist: ["final_modes", "suction_levels", "duration_buckets", "mode_sessions", "mode_minutes", "mode_minutes_per_session", "hours_by_day_type", "mode_by_level", "modes_used", "level_directions", "adjusts_per_session"],
    kpi: ["adjust_summary", "pause_stats"],
    trends: ["mode_session_trend", "mode_minutes_trend"],
}


@pytest.fixture(scope="module")
def marts(spark, tmp_path_factory):
    """Sessions of which many come again on other days, with other models and the same or other keys."""
    top = str(tmp_path_factory.mktemp("rollups"))
    rows = sessions_log(150, 11)
    events = explode_events(frame(spark, "raw", rows))
    events.write.parquet(f"{top}/events")
    events = spark.read.parquet(f"{top}/events")
    build_sessions(events).write.parquet(f"{top}/sessions")
    build_session_modes(events).write.parquet(f"{top}/modes")
    found = Marts(sessions=spark.read.parquet(f"{top}/sessions"), session_modes=spark.read.parquet(f"{top}/modes"), events=events)
    session_rollups(found.sessions, found.session_modes).write.parquet(f"{top}/rollups")
    found.rollups = spark.read.parquet(f"{top}/rollups")
    return found


def test_sessions_come_again(marts):
    again = marts.sessions.groupBy("useSessionId").count().where("count > 1").count()
    assert again > 20
    assert marts.rollups.where("prev_any is not null").count() > 20
    assert marts.rollups.where("prev_any is not null and prev_model is null").count() > 0


@pytest.mark.parametrize("span", [(0, 45), (0, 0), (7, 7), (3, 20), (21, 45), (60, 70)])
def test_reports_equal_those_from_sessions(marts, span):
    start, end = day(span[0]), day(span[1])
    for model in (None, "D1"):
        for module, names in REPORTS.items():
            for name in names:
                want = getattr(module, name)(marts, start, end, model)
                got = getattr(rollups, name)(marts, start, end, model)
                assert got.columns == want.columns, name
                assert content(got) == content(want), (name, model)
        assert content(rollups.top_hours(marts, start, end, model, top=None)) == content(dist.top_hours(marts, start, end, model, top=None))
        want = dist.hours_by_day_type(marts, start, end, model, weekday_source="evt_dt")
        assert content(rollups.hours_by_day_type(marts, start, end, model, weekday_source="evt_dt")) == content(want)


def test_same_session_with_two_models_and_keys(spark):
    """One id on three days: two models, one key that comes again and one that changes."""
    base = {"useSessionId": "s", "finalSuctionLevel": None, "mode_adj_cnt": 1, "level_adj_cnt": 0, "level_up_cnt": 0, "level_down_cnt": 0, "pause_cnt": 0}
    rows = [
        {**base, "evt_dt": "2024-01-01", "deviceCode": "D1", "finalModeType": "m"},
        {**base, "evt_dt": "2024-01-02", "deviceCode": "D2", "finalModeType": "m"},
        {**base, "evt_dt": "2024-01-04", "deviceCode": "D1", "finalModeType": "m"},
        {**base, "evt_dt": "2024-01-03", "deviceCode": None, "finalModeType": "n"},
    ]
    sessions = frame(spark, "sessions", rows)
    modes = frame(spark, "session_modes", [])
    got = session_rollups(sessions, modes).where("kind = 'final_mode'")
    found = {(str(r.evt_dt), r.k1, r.deviceCode): (r.prev_any and str(r.prev_any), r.prev_model and str(r.prev_model)) for r in got.collect()}
    assert found == {
        ("2024-01-01", "m", "D1"): (None, None),
        ("2024-01-02", "m", "D2"): ("2024-01-01", None),
        ("2024-01-03", "n", None): (None, None),
        ("2024-01-04", "m", "D1"): ("2024-01-02", "2024-01-01"),
    }
    marts = Marts(rollups=session_rollups(sessions, modes))
    count = lambda *a: [tuple(r)[:2] for r in rollups.final_modes(marts, *a).collect()]
    assert count("2024-01-01", "2024-01-04") == [("m", 1), ("n", 1)]
    assert count("2024-01-02", "2024-01-04", "D1") == [("m", 1)]
    assert count("2024-01-03", "2024-01-03") == [("n", 1)]
    empty = Marts(rollups=session_rollups(frame(spark, "sessions", []), modes))
    assert rollups.final_modes(empty, "2024-01-01", "2024-01-04").collect() == []
    assert set(schemas.column_names(schemas.ROLLUPS)) == set(marts.rollups.columns)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("section", ["overview", "duration", "habits"])
def test_sections_read_no_sessions(spark, section):
    tables = TestMarts(spark, SF_DIR)
    names = [t for t in SECTION_TABLES[section].split() if t not in ("sessions", "session_modes")]
    marts = tables.marts(*names, "rollups", "sessions", "session_modes")
    for name, df in run_section(marts, section, "2024-01-03", "2024-01-28").items():
        scans = [line for line in plan(df).splitlines() if "FileScan" in line]
        assert not [s for s in scans if "/sessions]" in s or "/session_modes]" in s], name
        own = [s for s in scans if "/rollups]" in s]
        assert len(own) <= 1 and all("PartitionFilters: [isnotnull(evt_dt" in s for s in own), name
