"""Daily batch runs with late data: which days are overwritten and what they hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from helpers import frame, log, rows, session
from tidemark.marts import Marts
from tidemark.plans.chain import run_chain
from tidemark.sources.tables import read_table, register_views, run_sql
from tidemark.sources.writers import upsert, write_days, write_frames

D = dt.date.fromisoformat


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Handfuls of rows: one partition saves most of the time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def use(i, day, reported, uid="a"):
    """Start and end of one session on ``day``, reported on ``reported``."""
    return [
        log(10 * i, f"{day}T10:00:00", "pump_session_start", f"s{i}", dt_=reported, uid=uid),
        log(10 * i + 1, f"{day}T10:20:00", "pump_session_end", f"s{i}", dt_=reported, uid=uid,
            modeDuration=[{"durationSec": 700 + i, "modeType": "m"}]),
    ]


LOGS = [
    *use(1, "2024-01-01", "2024-01-01"),
    *use(2, "2024-01-01", "2024-01-12", "b"),  # eleven days late
    *use(3, "2024-01-12", "2024-01-12"),
    *use(4, "2024-01-05", "2024-01-05"),
]


def sessions_after(spark, root):
    raw = frame(spark, "raw", LOGS)
    for day in ("2024-01-01", "2024-01-05", "2024-01-12"):
        run_chain(spark, raw, root, day)
    return rows(read_table(spark, root, "sessions"), "useSessionId", "evt_dt")


def test_late_rows_do_not_drop_earlier_ones(spark, tmp_path):
    one, twelve, five = D("2024-01-01"), D("2024-01-12"), D("2024-01-05")
    root = str(tmp_path / "full")
    assert sessions_after(spark, root) == [("s1", one), ("s2", one), ("s3", twelve), ("s4", five)]
    modes = rows(read_table(spark, root, "session_modes"), "useSessionId", "duration_sec")
    assert modes == [("s1", 701), ("s2", 702), ("s3", 703), ("s4", 704)]
    daily = read_table(spark, root, "daily").select("evt_dt", "dau", "cumulative_users", "cumulative_sessions")
    assert sorted(tuple(r) for r in daily.collect()) == [(one, 2, 2, 2), (five, 1, 2, 3), (twelve, 1, 2, 4)]
    retention = read_table(spark, root, "retention")
    assert retention.where("base_dt = '2024-01-12'").first()["d7_retained_users"] == 1
    assert retention.groupBy("base_dt").count().where("count > 1").count() == 0


def test_very_late_session_moves_retention(spark, tmp_path):
    """A session of 01-02, reported in February, changes retention of 01-02 and the cohort of 01-01."""
    root = str(tmp_path)
    raw = frame(spark, "raw", [*use(1, "2024-01-01", "2024-01-01"), *use(2, "2024-01-02", "2024-02-10"), *use(3, "2024-01-03", "2024-01-03", "b")])
    for day in ("2024-01-01", "2024-01-03", "2024-02-10"):
        run_chain(spark, raw, root, day)
    got = {str(r.base_dt): r for r in read_table(spark, root, "retention").collect()}
    assert got["2024-01-02"].d1_retained_users == 1 and got["2024-01-01"].cohort_d1_ret == 1.0
    first = {str(r.base_dt): r.new_users_base for r in got.values() if r.new_users_base}
    assert first == {"2024-01-01": 1, "2024-01-03": 1}


def test_late_first_day_moves_the_cohort(spark, tmp_path):
    root = str(tmp_path)
    raw = frame(spark, "raw", [*use(1, "2024-01-20", "2024-01-20"), *use(2, "2024-01-02", "2024-01-21")])
    for day in ("2024-01-20", "2024-01-21"):
        run_chain(spark, raw, root, day)
    got = {str(r.base_dt): r.new_users_base for r in read_table(spark, root, "retention").collect() if r.new_users_base}
    assert got == {"2024-01-02": 1}


def test_corrected_log_replaces_the_report_day(spark, tmp_path):
    """A rerun after a session has gone from the log removes it, its modes, its daily row and its days."""
    root = str(tmp_path)
    keep, gone = use(1, "2024-01-05", "2024-01-05"), use(2, "2024-01-03", "2024-01-05", "b")
    run_chain(spark, frame(spark, "raw", keep + gone), root, "2024-01-05")
    assert read_table(spark, root, "sessions").count() == 2
    run_chain(spark, frame(spark, "raw", keep), root, "2024-01-05")
    for table in ("events", "session_hours", "sessions", "session_modes", "daily"):
        assert {str(r.evt_dt) for r in read_table(spark, root, table).collect()} == {"2024-01-05"}, table
    got = {str(r.base_dt): r.new_users_base for r in read_table(spark, root, "retention").collect() if r.new_users_base}
    assert got == {"2024-01-05": 1}


def test_late_power_on_counts(spark, tmp_path):
    root = str(tmp_path)
    logs = [
        *use(1, "2024-01-01", "2024-01-01"),
        log(91, "2024-01-01T09:00:00", "pump_startup_evt", None, dt_="2024-01-01"),
        log(92, "2024-01-01T09:30:00", "pump_startup_evt", None, dt_="2024-01-20"),
    ]
    raw = frame(spark, "raw", logs)
    for day in ("2024-01-01", "2024-01-20"):
        run_chain(spark, raw, root, day)
    assert [r.power_on_cnt for r in read_table(spark, root, "daily").collect()] == [2]


def test_quiet_days_stay_untouched(spark, tmp_path):
    """A timeless event and a wrong clock rebuild their sessions once, not in every later run."""
    root = str(tmp_path)
    logs = [
        *use(1, "2024-01-01", "2024-01-01"),
        log(50, None, "pump_user_evt", "s1", dt_="2024-01-02", evtType="pause"),
        *use(2, "1970-01-01", "2024-01-02", "b"),
        *use(3, "2024-01-09", "2024-01-09", "c"),
    ]
    raw = frame(spark, "raw", logs)
    for day in ("2024-01-01", "2024-01-02"):
        run_chain(spark, raw, root, day)
    got = rows(read_table(spark, root, "sessions"), "useSessionId", "pause_cnt")
    assert got == [("s1", 1), ("s2", 0)]

    def files():
        tables = ("sessions", "session_hours", "session_modes", "daily")
        return {p: p.stat().st_mtime_ns for t in tables for p in (tmp_path / t).rglob("part-*") if "2024-01-09" not in str(p)}

    seen = files()
    run_chain(spark, raw, root, "2024-01-09")
    assert files() == seen


def test_empty_session_id_is_no_session(spark, tmp_path):
    logs = [log(1, "2024-01-01T10:00:00", "pump_session_start", "", dt_="2024-01-01"), *use(1, "2024-01-01", "2024-01-01")]
    run_chain(spark, frame(spark, "raw", logs), str(tmp_path), "2024-01-01")
    assert rows(read_table(spark, str(tmp_path), "sessions"), "useSessionId") == [("s1",)]


def test_late_end_completes_an_old_session(spark, tmp_path):
    root = str(tmp_path)
    logs = [
        log(1, "2024-01-01T23:50:00", "pump_session_start", "s", dt_="2024-01-01"),
        log(2, "2024-01-01T10:00:00", "pump_session_start", "t", dt_="2024-01-01"),
        log(3, "2024-01-02T00:10:00", "pump_session_end", "s", dt_="2024-01-20",
            modeDuration=[{"durationSec": 900, "modeType": "m"}]),
        log(4, None, "pump_user_evt", "t", dt_="2024-01-20", evtType="pause"),
    ]
    raw = frame(spark, "raw", logs)
    for day in ("2024-01-01", "2024-01-20"):
        run_chain(spark, raw, root, day)
    got = rows(read_table(spark, root, "sessions"), "useSessionId", "evt_dt", "is_complete", "pause_cnt")
    assert got == [("s", D("2024-01-01"), 1, 0), ("t", D("2024-01-01"), 0, 1)]
    daily = read_table(spark, root, "daily").select("total_sessions", "complete_sessions").collect()
    assert [tuple(r) for r in daily] == [(2, 1)]


def test_rerun_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "again")
    first = sessions_after(spark, root)
    run_chain(spark, frame(spark, "raw", LOGS), root, "2024-01-12")
    assert rows(read_table(spark, root, "sessions"), "useSessionId", "evt_dt") == first


def test_write_days_touches_only_its_days(spark, tmp_path):
    root = str(tmp_path)
    write_days(frame(spark, "sessions", [session(1, "2024-01-01"), session(2, "2024-01-02")]), root, "sessions")
    write_days(frame(spark, "sessions", [session(3, "2024-01-02")]), root, "sessions")
    got = read_table(spark, root, "sessions")
    assert rows(got, "useSessionId") == [("1",), ("3",)]
    assert got.columns[0] == "evt_dt"  # table order, although the day is a partition column


def test_marts_and_sql(spark, tmp_path):
    root = str(tmp_path / "m")
    run_chain(spark, frame(spark, "raw", LOGS), root, "2024-01-12")
    marts = Marts.read(spark, root)
    register_views(marts)
    got = run_sql(spark, "SELECT count(*) FROM sessions WHERE uid = :uid", {"uid": "b"}).first()[0]
    assert got == 1
    paths = write_frames({"a": marts.daily, "b": marts.sessions.select("uid")}, str(tmp_path / "out"), "json")
    assert spark.read.json(paths["b"]).count() == marts.sessions.count()


@pytest.mark.parametrize("table", ["raw", "events", "session_hours", "sessions", "session_modes", "daily", "retention", "user_flags", "devices"])
def test_round_trip(spark, tmp_path, table):
    df = frame(spark, table, [])
    write_days(df, str(tmp_path), table)
    (tmp_path / table).mkdir(exist_ok=True)
    assert read_table(spark, str(tmp_path), table).schema.simpleString() == df.schema.simpleString()


def test_upsert_keeps_the_newer_row(spark, tmp_path):
    root = str(tmp_path)

    def event(id_, day, written, name, evt_dt=None):
        return {"id": id_, "dt": day, "writetime": written, "eventName": name, "evt_dt": evt_dt}

    def load(*events):
        upsert(frame(spark, "events", list(events)), root, "events", [F.col("writetime")])
        return rows(read_table(spark, root, "events"), "id", "dt", "eventName")

    one, two = D("2024-01-01"), D("2024-01-02")
    load(event(1, "2024-01-01", 20, "new", "2024-01-01"), event(2, "2024-01-01", 5, "a", "2023-12-31"), event(9, "2024-01-02", 5, "other"))
    # A late copy of an old row, a newer copy that moves to another event day, an equal one, a new key, a key met twice.
    got = load(
        event(1, "2024-01-01", 10, "old", "2024-01-01"), event(2, "2024-01-01", 6, "b", "2024-01-01"),
        event(3, "2024-01-01", 1, "c"), event(3, "2024-01-01", 2, "d"), event(4, "2024-01-01", None, None),
    )
    assert got == [(1, one, "new"), (2, one, "b"), (3, one, "d"), (4, one, None), (9, two, "other")]
    assert load(event(1, "2024-01-01", 20, "again", "2024-01-01"))[0] == (1, one, "again")
    assert load() == [(1, one, "again"), (2, one, "b"), (3, one, "d"), (4, one, None), (9, two, "other")]
    with pytest.raises(ValueError):
        upsert(frame(spark, "first_seen", []), root, "first_seen", [F.col("day")])


def test_merging_rerun_adds_to_a_report_day(spark, tmp_path):
    def run(root, *parts, merge):
        for part in parts:
            run_chain(spark, frame(spark, "raw", part), str(tmp_path / root), "2024-01-12", merge=merge)
        return {t: rows(read_table(spark, str(tmp_path / root), t), *columns) for t, columns in tables.items()}

    tables = {"sessions": ["useSessionId", "end_time", "uid"], "events": ["id", "writetime", "eventName"], "daily": ["evt_dt", "dau", "total_sessions"]}
    whole = use(1, "2024-01-12", "2024-01-12") + use(2, "2024-01-11", "2024-01-12", "b")
    old_copy = [{**whole[0], "writetime": 1, "content": whole[1]["content"]}]
    expected = run("whole", whole, merge=False)
    assert run("parts", whole[:3], [*whole[3:], *old_copy], merge=True) == expected
    assert len(run("replaced", whole[:2], whole[2:], merge=False)["sessions"]) == 1  # a rerun replaces unless told to merge
