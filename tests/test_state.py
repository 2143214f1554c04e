"""Nightly runs on kept state: equal to a full rebuild, safe to stop anywhere, and reading changed days only."""

import datetime as dt
import random
import re
import shutil

import pytest
from helpers import frame, log
from tidemark import schemas
from tidemark.marts import Marts
from tidemark.operators import distributions as dist
from tidemark.plans import chain, state
from tidemark.plans.chain import chain_steps, rebuild_state, run_chain
from tidemark.plans.daily import build_daily, cumulative
from tidemark.plans.retention import build_retention
from tidemark.plans.sessions import build_session_modes, build_sessions
from tidemark.sources import writers
from tidemark.sources.tables import read_table

TABLES = ["events", "session_hours", "session_days", "sessions", "session_modes", "activity_bits", "first_seen", "increments", "rollups", "daily", "retention"]
FIRST = dt.date(2024, 1, 20)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def content(df):
    return sorted((tuple(sorted((k, str(v)) for k, v in r.asDict(recursive=True).items())) for r in df.collect()))


def tables(spark, root):
    """Contents of all tables; base days without any count say nothing, runs may differ in them."""
    found = {t: content(read_table(spark, root, t)) for t in TABLES}
    found["retention"] = [r for r in found["retention"] if any(v not in ("0", "None", "ALL") for k, v in r if k != "base_dt")]
    return found


def day(n):
    return (FIRST + dt.timedelta(days=n)).isoformat()


def sessions_log(n, seed):
    """Sessions of some users, devices and models over 40 days, a third of them reported late; ids come again on other days."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        start, late = rng.randrange(40), rng.choice([0, 0, 1, 9])
        sid, uid = f"s{rng.randrange(n)}", rng.choice([None, "a", "b", "c", "d", "e"])
        model, payload = rng.choice(["D1", "D2", None]), f"0-00{rng.randrange(3)}"
        shared = {"dt_": day(start + late), "uid": uid, "payload": payload, "deviceCode": model}
        rows.append(log(10 * i, f"{day(start)}T23:50:00", "pump_session_start", sid, **shared))
        rows.append(log(10 * i + 1, f"{day(start)}T23:55:00", "pump_manual_adjust_evt", sid, evtType="pump_mode", adjustFrom="1", adjustTo="2", **shared))
        if rng.random() < 0.8:
            shared["dt_"] = day(start + rng.choice([1, 1, 9]))
            rows.append(log(10 * i + 2, f"{day(start + 1)}T00:10:00", "pump_session_end", sid, modeDuration=[{"durationSec": 500 + i, "modeType": "m"}], **shared))
        if rng.random() < 0.3:
            rows.append(log(10 * i + 3, f"{day(start)}T08:00:00", "pump_startup_evt", None, **shared))
    return rows


def check_against_rebuild(spark, root, other):
    """Every table equals what a rebuild from the stored events gives, state included."""
    marts, events = Marts.read(spark, root), read_table(spark, root, "events")
    sessions = build_sessions(events)
    assert content(marts.sessions) == content(sessions)
    assert content(marts.session_modes) == content(build_session_modes(events))
    assert content(marts.daily) == content(build_daily(sessions, events))
    days = sorted(r.base_dt for r in marts.retention.select("base_dt").collect())
    assert days[0] <= FIRST and len(days) >= 40
    whole = build_retention(sessions, days[0].isoformat(), days[-1].isoformat())
    assert content(marts.retention) == content(whole.where(whole.base_dt.isin(days)))
    for name in ("session_hours", "sessions", "session_modes"):
        shutil.copytree(f"{root}/{name}", f"{other}/{name}")
    rebuild_state(spark, other)
    for name in ("session_days", "activity_bits", "first_seen", "increments", "rollups"):
        assert content(read_table(spark, root, name)) == content(read_table(spark, other, name)), name
    from tidemark.plans.daily import running_totals

    assert content(running_totals(marts.increments)) == content(cumulative(sessions))
    plain = Marts(sessions=sessions)
    for span in ((), (day(3), day(20))):
        assert content(dist.streaks_from_bits(marts, *span)) == content(dist.streaks(plain, *span))
    for model in (None, "D1"):
        assert content(dist.weekly_cohorts_from_bits(marts, day(2), day(30), model)) == content(dist.weekly_cohorts(plain, day(2), day(30), model))


def test_nights_equal_a_rebuild(spark, tmp_path):
    """A first load, ordinary nights, and old report days run again with rows gone, changed and added."""
    root, rows = str(tmp_path / "w"), sessions_log(120, 5)
    run_chain(spark, frame(spark, "raw", rows), root, day(30), first_report=day(0))
    run_chain(spark, frame(spark, "raw", rows), root, day(50), first_report=day(31))
    fewer = [r for r in rows if r["id"] % 3] + sessions_log(40, 8)[1:]
    run_chain(spark, frame(spark, "raw", fewer), root, day(12), first_report=day(2))
    check_against_rebuild(spark, root, str(tmp_path / "again"))


def use(i, when, reported, uid="a"):
    return [
        log(10 * i, f"{when}T10:00:00", "pump_session_start", f"s{i}", dt_=reported, uid=uid),
        log(10 * i + 1, f"{when}T10:20:00", "pump_session_end", f"s{i}", dt_=reported, uid=uid, modeDuration=[{"durationSec": 700 + i, "modeType": "m"}]),
    ]


OLD = [*use(1, "2024-01-01", "2024-01-12"), *use(2, "2024-01-12", "2024-01-12", "b"), *use(5, "2024-01-02", "2024-01-12", "b")]
CORRECTED = [*use(2, "2024-01-12", "2024-01-12", "b"), *use(3, "2024-01-03", "2024-01-12", "c")]
NEXT = use(4, "2024-01-13", "2024-01-13")


@pytest.fixture(scope="module")
def stopped(spark, tmp_path_factory):
    """A warehouse after the old log, and the tables that undisturbed nights would leave with and without the corrected log."""
    top = tmp_path_factory.mktemp("stopped")
    run_chain(spark, frame(spark, "raw", OLD), str(top / "old"), "2024-01-12")
    wanted = {}
    for name, before in (("whole", [CORRECTED]), ("unread", [])):
        shutil.copytree(top / "old", top / name)
        for rows in before:
            run_chain(spark, frame(spark, "raw", rows), str(top / name), "2024-01-12")
        run_chain(spark, frame(spark, "raw", NEXT), str(top / name), "2024-01-13")
        wanted[name] = tables(spark, str(top / name))
    return top / "old", wanted


@pytest.mark.parametrize("step", ["record", "events", "session_days", "sessions", "session_modes", "rollups", "first_seen"])
def test_a_stopped_run_is_taken_over(spark, stopped, tmp_path, step):
    """The next night's run finishes what the stopped one had begun; its record is then gone."""
    old, wanted = stopped
    root = str(tmp_path / "w")
    shutil.copytree(old, root)
    for name in chain_steps(spark, frame(spark, "raw", CORRECTED), root, "2024-01-12"):
        if name == step:
            break
    assert read_table(spark, root, "run_days").count() > 0
    run_chain(spark, frame(spark, "raw", NEXT), root, "2024-01-13")
    got, want = tables(spark, root), wanted["unread" if step == "record" else "whole"]
    for table in TABLES:
        assert got[table] == want[table], table
    assert read_table(spark, root, "run_days").count() == read_table(spark, root, "run_ids").count() == 0


def test_a_night_reads_only_what_it_needs(spark, tmp_path, monkeypatch):
    """In all that a night writes, large tables are read by partition: no scan of sessions, hours or events without a filter."""
    root, rows = str(tmp_path), sessions_log(30, 3)
    last = max(r["dt"] for r in rows)  # the log's last report day, the night to look at
    until = (dt.date.fromisoformat(last) - dt.timedelta(days=1)).isoformat()
    run_chain(spark, frame(spark, "raw", rows), root, until, first_report=day(0))
    plans, write = [], writers.write_days

    def spy(df, *args, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **options)

    monkeypatch.setattr(writers, "write_days", spy)
    monkeypatch.setattr(chain, "write_days", spy)
    run_chain(spark, frame(spark, "raw", rows), root, last)
    scans = [line for text in plans for line in text.split("\n") if "FileScan" in line]
    for table in ("events", "session_hours", "sessions", "session_modes"):
        own = [line for line in scans if re.search(rf"Location: [^,]*/{table}\]", line) and "_staging" not in line]
        assert own, table
        assert all(re.search(r"PartitionFilters: \[[^\]]", line) for line in own), [line for line in own][:2]


def test_bits_of_days_come_and_go(spark):
    rows = [{"evt_dt": d, "uid": u, "pump_device_id": None, "useSessionId": u + d, "deviceCode": "D"} for d, u in (("1969-12-31", "a"), ("2024-01-31", "a"), ("2024-02-01", "b"))]
    bits = state.active_bits(frame(spark, "sessions", rows))
    assert sorted((r.id, r.period, r.bits) for r in bits.collect()) == [("a", -1, 1 << 31), ("a", 617, 1 << 9), ("b", 617, 1 << 10)]
    firsts = {r.id: str(r.day) for r in state.first_day(bits).collect()}
    assert firsts == {"a": "1969-12-31", "b": "2024-02-01"}
    changed = state.updated_bits(bits, frame(spark, "sessions", rows[2:]), [dt.date(2024, 1, 31), dt.date(2024, 2, 1)])
    assert [(r.id, r.bits) for r in changed.collect()] == [("b", 1 << 10)]
    assert set(schemas.column_names(schemas.ACTIVITY_BITS)) == set(changed.columns)
