"""Wide rows are moved once or not at all, and the rows stay what they were."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from checks import registry, testmap
from checks.store import TestMarts
from helpers import frame, log, session
from test_chain import LOGS
from tidemark import session as settings
from tidemark.plans import state
from tidemark.plans.chain import _counted, _one_each, run_chain
from tidemark.plans.daily import POWER_ON, increments
from tidemark.plans.events import explode_events, latest_events
from tidemark.plans.sessions import days_and_starts, id_bucket
from tidemark.sources import writers
from tidemark.sources.tables import read_table


def found(df):
    return sorted(map(str, df.collect()))


def test_upsert_by_parts_and_of_frequent_keys(spark, tmp_path, monkeypatch):
    """Keys above the limit, missing ids and keys met once: the last copy of each, by whichever way it goes."""
    day = dt.date(2024, 1, 5)
    event = lambda id_, written, name: {"id": id_, "dt": day, "writetime": written, "eventName": name, "evt_dt": day}
    loads = [[event(1, 5, "a"), event(1, 7, "b"), event(1, 6, "c"), event(None, 1, "d"), event(2, 1, "e")], [event(1, 6, "f"), event(None, 2, "g"), event(None, 1, "h"), event(3, 1, "i")]]
    results = []
    for limit in (1, 10_000):
        monkeypatch.setattr(writers, "MANY_ROWS", limit)
        root = str(tmp_path / str(limit))
        for load in loads:
            writers.upsert(frame(spark, "events", load), root, "events", [F.col("writetime")])
        results.append(sorted(((r.id or 0, r.eventName) for r in read_table(spark, root, "events").collect())))
    assert results[0] == results[1] == [(0, "g"), (1, "b"), (2, "e"), (3, "i")]


@pytest.mark.parametrize("sent", [100, 0])
def test_merged_rows_are_taken_from_their_files(spark, tmp_path, monkeypatch, sent):
    """Rows that are dealt by day are merged without moving any of their columns but the key, however little Spark would broadcast; with very many
    bitmaps it may move them, for the same rows."""
    monkeypatch.setattr(writers, "SPAN", 3)  # several bitmaps a file
    monkeypatch.setattr(writers, "SENT_SPANS", sent)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _merged_rows(spark, tmp_path, monkeypatch, bool(sent))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _merged_rows(spark, tmp_path, monkeypatch, sent):
    plans, write = [], writers.write_days
    monkeypatch.setattr(writers, "write_days", lambda df, *args, **options: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *args, **options))
    root, days = str(tmp_path), [dt.date(2024, 1, 5), dt.date(2024, 1, 6), None]
    event = lambda n, written, name: {"id": None if n == 11 else n, "dt": days[n % 2], "writetime": written, "eventName": name, "evt_dt": days[n % 3]}
    first = [event(n, 5, "a") for n in range(0, 30, 3)]
    writers.upsert(frame(spark, "events", first), root, "events", [F.col("writetime")], dealt=True)
    assert not plans  # nothing to merge: the files written first are the table's
    again = [event(n, 5 if n % 2 else 4, "b") for n in range(30)] + [event(7, 6, "c"), event(11, 6, "c"), event(11, 2, "d")]
    writers.upsert(frame(spark, "events", again), root, "events", [F.col("writetime")], dealt=True)
    writers.upsert(frame(spark, "events", []), root, "events", [F.col("writetime")], dealt=True)
    got = {r.id: (r.eventName, r.dt, r.evt_dt) for r in read_table(spark, root, "events").collect()}
    name = lambda n: "c" if n in (7, 11) else "a" if n % 6 == 0 else "b"
    assert got == {None if n == 11 else n: (name(n), days[n % 2], days[n % 3]) for n in range(30)}
    assert read_table(spark, root, "events").count() == 30
    assert plans and sent != any(re.search(r"(?<!Broadcast)Exchange", plan) for plan in plans)


def test_staged_files_become_the_tables(spark, tmp_path):
    root, day = str(tmp_path), lambda n: dt.date(2024, 1, n)
    rows = frame(spark, "sessions", [session(n, day(1 + n % 3)) for n in range(9)])
    writers.replace_days(rows, root, "sessions", [day(1), day(2), day(3)])
    staged = writers.stage(rows.where("evt_dt = '2024-01-01'"), root, "sessions")
    files = {path.rsplit("/", 1)[1] for path in staged.inputFiles()}
    writers.publish(spark, root, "sessions", [day(1), day(2)])
    table = read_table(spark, root, "sessions")
    assert files < {path.rsplit("/", 1)[1] for path in table.inputFiles()}
    assert sorted(r.evt_dt for r in table.collect()) == [day(1)] * 3 + [day(3)] * 3


def test_a_night_writes_its_rows_once(spark, tmp_path, monkeypatch):
    """Rows are written where they are staged and put in place from there; retention has no staging."""
    written, write = [], writers.write_days
    monkeypatch.setattr(writers, "write_days", lambda df, root, name, *args, **options: written.append((root, name)) or write(df, root, name, *args, **options))
    root = str(tmp_path)
    run_chain(spark, frame(spark, "raw", LOGS), root, "2024-01-12", first_report="2024-01-01")
    assert {r for r, _ in written} == {f"{root}/_staging/2024-01-12"}
    assert [name for _, name in written].count("events") == 1 and read_table(spark, root, "events").count() == len(LOGS)


def test_days_and_ids_of_a_night_come_from_one_look(spark):
    """Distinct pairs of id and day of the events that count; power-ons and events of no session have a day only or do not count."""
    row = lambda name, sid, day, kind=None: {"eventName": name, "useSessionId": sid, "evt_dt": day and dt.date(2024, 1, day), "evtType": kind}
    events = [row("pump_session_start", "a", 1), row("pump_session_end", "a", 1), row("pump_session_end", "a", 2), row("pump_session_start", "", 3)]
    events += [row(POWER_ON, "b", 4), row(POWER_ON, None, 4), row("pump_user_evt", "c", 5, "pause"), row("pump_user_evt", "d", 6), row("pump_session_end", "e", None)]
    got = sorted(((r.useSessionId or "", r.evt_dt and r.evt_dt.day or 0) for r in _counted(frame(spark, "events", events)).collect()))
    assert got == [("", 4), ("a", 1), ("a", 2), ("c", 5), ("e", 0)]


def test_days_and_starts_of_ids(spark):
    index = [{"evt_dt": dt.date(2024, 1, n), "useSessionId": sid, "started": started} for n, sid, started in ((1, "a", True), (2, "a", False), (2, "b", True), (3, "c", False))]
    rows = frame(spark, "session_days", index).withColumn("bucket", id_bucket(4))
    ids = rows.where("useSessionId != 'b'").select("useSessionId")
    held, started = days_and_starts(rows, ids, 4)
    assert (sorted(d.day for d in held), [d.day for d in started]) == ([1, 2, 3], [1])


def test_log_is_dealt_by_event_day_and_report_day(spark, tmp_path):
    """A task of the log makes rows of few days of either kind, so that it writes few files."""
    _events_of_days(spark, tmp_path)
    plan = testmap.raw_log(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"rangepartitioning\(d#\d+ ASC NULLS FIRST, \S*#\d+ ASC NULLS FIRST, event_id#|rangepartitioning\(d#\d+ ASC NULLS FIRST, date_add\(d#", plan)


def test_only_repeated_keys_of_a_log_are_compared(spark, tmp_path):
    again = [{**LOGS[0], "writetime": (LOGS[0].get("writetime") or 0) + 5, "createtime": 1}, {**LOGS[0], "writetime": (LOGS[0].get("writetime") or 0) + 9, "content": "{}"}]
    for number, rows in enumerate(([*LOGS], [*LOGS, *again])):
        raw = frame(spark, "raw", rows)
        got = explode_events(_one_each(raw, str(tmp_path / str(number))))
        assert found(got) == found(latest_events(explode_events(raw)))


def test_events_are_written_by_the_tasks_that_make_them(spark, tmp_path):
    rows = [(n, dt.datetime(2024, 1, 1 + n % 3, 4), n, "view", 30.0 * n, f'{{"k": {n}}}') for n in range(30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    plan = explode_events(testmap.raw_log(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning(d#" in plan


def test_events_of_one_name_are_those_of_all_events(spark):
    """The name plain, in a text within the text, with escaped characters at either level, as another field's value, and in no JSON at all."""
    when = "2024-01-05T10:00:00"
    rows = [log(1, when, POWER_ON), log(2, when, POWER_ON, as_text=True), log(3, when, "pump_user_evt", evtType=POWER_ON), log(4, when, "pump_session_start")]
    rows += [{**rows[n], "id": 5 + n, "content": rows[n]["content"].replace("pump_startup", f"pum{sign}startup")} for n, sign in ((0, "\\u0070_"), (1, "\\\\u0070_"), (1, "\\u0070\\u005f"))]
    rows += [{**rows[0], "id": 9, "content": POWER_ON}, {**rows[0], "id": 10, "content": None}, {**rows[0], "id": 11, "eventname": "Page Log"}]
    raw = frame(spark, "raw", rows)
    got = explode_events(raw, name=POWER_ON)
    assert found(got) == found(explode_events(raw).where(F.col("eventName") == POWER_ON))
    assert {r.id for r in got.collect()} == {1, 2, 5, 6}


def test_texts_without_the_name_are_not_parsed(spark):
    plan = explode_events(frame(spark, "raw", [LOGS[0]]), name=POWER_ON)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_tuple(CASE WHEN (Contains(content" in plan


def test_running_totals_scan_sessions_once(spark):
    days = ["2024-01-01", "2024-01-02", None]
    rows = [session(n % 4, day, uid, deviceCode=model, total_duration_sec=None if n == 2 else n) for n, (day, uid, model) in enumerate((d, u, m) for d in days for u in ("a", "b", None) for m in ("D1", None))]
    totals = increments(frame(spark, "sessions", rows))
    assert totals._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = {(str(r.evt_dt), r.deviceCode): (r.model_users, r.new_users, r.any_users, r.model_sessions, r.any_sessions, r.seconds) for r in totals.collect()}
    assert got["2024-01-01", "D1"] == (2, 2, 0, 2, 2, 4) and got["2024-01-01", None][5] == 9
    assert sum(v[2] for v in got.values()) == 2 and sum(v[4] for v in got.values()) == 4


def test_log_rows_of_odd_sessions(spark, tmp_path):
    """The fields of an event and their order; unknown values are left out."""
    rows = [(1, dt.datetime(2024, 1, 1, 4), 5, "view", 30.0, '{"k": 27}'), (2, None, None, "view", None, None), (4, dt.datetime(2024, 1, 2, 4), 6, "view", 1.0, '{"k": 3}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    log_rows = testmap.raw_log(spark, str(tmp_path))
    assert "named_struct(n," not in log_rows._jdf.queryExecution().optimizedPlan().toString()
    texts = {r.id: r.content for r in log_rows.collect()}
    assert len(texts) == 12 + 2 + 9 and texts[200] == '{"extraData":{"eventName":"pump_startup_evt","useSessionId":"2","payload":"00000000-000"},"eventSessionId":"s2","deviceId":"phone","os":"iOS","timezoneOffset":"GMT+0"}'
    assert json.loads(json.loads(texts[190])["extraData"]) == {"eventName": "pump_session_end", "evtTimestamp": 1704081600090, "useSessionId": "1", "deviceCode": "D2", "payload": "00000000-001", "evtSource": "local_device", "finalModeType": "massage", "finalSuctionLevel": "13", "modeDuration": [{"durationSec": 600, "modeType": "massage"}], "usedModeCount": 1, "endReason": "timeout"}


def _events_of_days(spark, path):
    """Sessions of nine days, some without a day or a number; a third of them are reported late."""
    rows = [(n, dt.datetime(2024, 1, 1 + n % 9, 4), n, "view", 30.0 * n, f'{{"k": {n}}}') for n in range(90)]
    rows += [(90, None, 1, "view", 1.0, '{"k": 1}'), (93, dt.datetime(2024, 1, 4), 1, "view", None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")


def test_log_of_some_days_is_made_by_as_many_tasks_as_their_sessions_need(spark, tmp_path, monkeypatch):
    _events_of_days(spark, tmp_path)
    days = [dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    part = testmap.raw_log(spark, str(tmp_path), days)
    assert found(part) == found(testmap.raw_log(spark, str(tmp_path)).where(F.col("dt").isin(days))) and part.count() > 100
    monkeypatch.setattr(testmap, "SESSIONS_A_FILE", 1)
    sessions = part.where("eventname = 'Pump Log'").selectExpr("id div 100").distinct().count()
    plan = testmap.raw_log(spark, str(tmp_path), days)._jdf.queryExecution().optimizedPlan().toString()
    assert f"], {sessions}\n" in plan


def test_two_runs_read_a_stored_log(spark, tmp_path, monkeypatch):
    _events_of_days(spark, tmp_path)
    logs = []
    monkeypatch.setattr(registry, "run_chain", lambda spark, raw, *rest, **options: logs.append(raw._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(registry, "read_table", lambda spark, root, name: read_table(spark, root, "raw"))
    registry._two_runs(TestMarts(spark, str(tmp_path)))
    assert len(logs) == 3 and not any("Generate" in log or "RepartitionByExpression" in log for log in logs)


def test_bits_are_opened_once_for_ids_of_the_same_days(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-08"]
    rows = frame(spark, "sessions", [session(f"{uid}{day}", day, uid) for uid in ("a", "b", "c", None) for day in days])
    bits = state.active_bits(rows).localCheckpoint()
    ledger = state.all_first_seen(rows, bits, 4)
    opened = state.retention_from_bits(bits, ledger, [dt.date(2024, 1, 2), dt.date(2024, 1, 8)])
    assert "count(1) AS ids" in opened._jdf.queryExecution().optimizedPlan().toString()
    got = {str(r.base_dt): (r.base_users, float(r.d1_user_ret or 0), float(r.d7_user_ret or 0)) for r in opened.collect()}
    assert got["2024-01-02"] == (4, 0.75, 0.0)


def test_tasks_of_the_log_and_its_shuffles_follow_the_sessions(spark, tmp_path, monkeypatch):
    """No task of the chain grows with the log: neither those that make it nor those that group its events, however few partitions are set."""
    _events_of_days(spark, tmp_path)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    before = found(registry.QUERIES["m_chain_from_raw_log"](spark, str(tmp_path)))
    monkeypatch.setattr(testmap, "SESSIONS_A_TASK", 2)
    monkeypatch.setattr(settings, "ROWS_A_PARTITION", 4)
    try:
        chain = registry.QUERIES["m_chain_from_raw_log"](spark, str(tmp_path))
        plan = chain._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"rangepartitioning\(d#.*, 46\)", plan)
        assert re.findall(r"hashpartitioning\(useSessionId#.*?, (\d+)\)", plan) == ["23"] * 4
        assert found(chain) == before
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        testmap.raw_log(spark, str(tmp_path))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
