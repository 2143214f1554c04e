"""Event explode, session build and session modes on hand-made logs."""

import datetime as dt

from helpers import frame, log, rows
from tidemark.plans.events import explode_events, latest_events
from tidemark.plans.sessions import build_session_modes, build_sessions

D = dt.date.fromisoformat


def events(spark, *logs):
    return explode_events(frame(spark, "raw", list(logs)))


def test_extra_data_forms(spark):
    logs = [
        log(1, "2024-01-01T10:00:00", "pump_session_start"),
        log(2, "2024-01-01T10:00:00", "pump_session_start", as_text=True),
        {**log(3, "2024-01-01T10:00:00", "x"), "content": '{"os": "iOS"}'},
        {**log(4, "2024-01-01T10:00:00", "x"), "content": "not json"},
        {**log(5, "2024-01-01T10:00:00", "x"), "content": None},
        {**log(6, "2024-01-01T10:00:00", "x"), "eventname": "Other"},
        {**log(7, "2024-01-01T10:00:00", "x"), "content": '{"extraData": null}'},
        {**log(8, "2024-01-01T10:00:00", "x"), "content": '{"extraData": "broken {"}'},
    ]
    got = rows(events(spark, *logs), "id", "eventName", "useSessionId", "os")
    assert got == [(1, "pump_session_start", "s1", "iOS"), (2, "pump_session_start", "s1", "iOS"), (8, None, None, None)]


def test_time_zones(spark):
    zones = ["GMT+8", "GMT-5", "GMT+5:30", "UTC", None, "GMT+14"]
    logs = [log(i, "2024-01-05T20:30:00", "x", zone=z) for i, z in enumerate(zones)]
    got = rows(events(spark, *logs), "id", "evt_dt", "evtTimestamp_local", "local_hour", "is_weekday")
    day = D("2024-01-05")  # a Friday in UTC
    assert got == [
        (0, day, dt.datetime(2024, 1, 6, 4, 30), 4, 0),
        (1, day, dt.datetime(2024, 1, 5, 15, 30), 15, 1),
        (2, day, dt.datetime(2024, 1, 6, 1, 30), 1, 0),  # half hours are dropped
        (3, day, None, None, 0),  # unknown local time: hour NULL, weekday 0
        (4, day, None, None, 0),
        (5, day, dt.datetime(2024, 1, 6, 10, 30), 10, 0),
    ]


def test_times_do_not_depend_on_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = rows(events(spark, log(1, "2024-03-10T02:30:00", "x")), "evtTimestamp_dt", "evt_dt", "local_hour")
        assert got == [(dt.datetime(2024, 3, 10, 2, 30), D("2024-03-10"), 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_payload_and_missing_time(spark):
    logs = [
        log(1, "2024-01-01T10:00:00", "x", payload="12345678abc"),
        log(2, "2024-01-01T10:00:00", "x", payload="12345678abcd"),
        log(3, "2024-01-01T10:00:00", "x", payload="12345678abcdefgh"),
        log(4, "2024-01-01T10:00:00", "x", payload=None),
        log(5, "2024-01-01T10:00:00", "x", uid=None),
        log(6, None, "x"),
    ]
    got = dict(rows(events(spark, *logs), "id", "pump_device_id"))
    assert got == {1: None, 2: "aabcd", 3: "aabcd", 4: None, 5: None, 6: "a-001"}
    assert rows(events(spark, logs[5]), "evt_dt", "evtTimestamp_dt") == [(None, None)]


def test_direction_and_duration(spark):
    def level(i, before, after):
        return log(i, "2024-01-01T10:00:00", "a", evtType="suction_level", adjustFrom=before, adjustTo=after)

    logs = [level(1, "3", "5"), level(2, "5", "3"), level(3, "5", "5"), level(4, "x", "5"), level(5, None, "5")]
    logs.append(log(6, "2024-01-01T10:00:00", "a", evtType="pump_mode", adjustFrom="1", adjustTo="2"))
    got = dict(rows(events(spark, *logs), "id", "adjust_direction"))
    assert got == {1: "up", 2: "down", 3: "same", 4: "same", 5: "same", 6: None}

    two = [{"durationSec": 17, "modeType": "m"}, {"durationSec": 3, "modeType": "n"}]
    logs = [
        log(1, "2024-01-01T10:00:00", "e", modeDuration=two),
        log(2, "2024-01-01T10:00:00", "e", modeDuration=[]),
        log(3, "2024-01-01T10:00:00", "e", modeDuration='[{"durationSec": 5, "modeType"'),
        log(4, "2024-01-01T10:00:00", "e"),
    ]
    assert dict(rows(events(spark, *logs), "id", "total_duration_sec")) == {1: 20, 2: None, 3: 5, 4: None}


def test_same_id_keeps_row_written_last(spark):
    logs = [
        log(1, "2024-01-01T10:00:00", "first", writetime=1000),
        log(1, "2024-01-01T10:00:00", "last", writetime=3000),
        log(1, "2024-01-01T10:00:00", "middle", writetime=2000),
        log(1, "2024-01-01T10:00:00", "other day", dt_="2024-01-02"),
    ]
    assert rows(latest_events(events(spark, *logs)), "dt", "eventName") == [
        (D("2024-01-01"), "last"),
        (D("2024-01-02"), "other day"),
    ]


def mode(i, when, before, after, sid="s1", source="remote_app", **extra):
    return log(
        i, when, "pump_manual_adjust_evt", sid, evtType="pump_mode", evtSource=source, adjustFrom=before, adjustTo=after, **extra
    )


def test_session_columns(spark):
    logs = [
        log(1, "2024-01-01T10:00:00", "pump_session_start"),
        mode(3, "2024-01-01T11:00:01", "2", "3", source="manual"),  # the next hour
        mode(2, "2024-01-01T10:30:00", "0", "1"),
        mode(5, "2024-01-01T11:00:01", "3", "7"),  # same time: by id
        mode(4, "2024-01-01T11:00:01", None, "3"),  # counted, but no path entry
        log(6, "2024-01-01T10:00:05", "pump_user_evt", evtType="pause"),
        log(7, "2024-01-01T10:00:06", "pump_user_evt", evtType="start"),
        log(8, "2024-01-01T11:00:00", "pump_session_end", finalModeType="m", usedModeCount=2, finalSuctionLevel="4",
            endReason="user", modeDuration=[{"durationSec": 601, "modeType": "m"}]),
    ]
    row = build_sessions(events(spark, *logs)).collect()[0].asDict()
    assert row["mode_adj_cnt"] == 4 and row["app_op_cnt"] == 3 and row["manual_op_cnt"] == 1 and row["pause_cnt"] == 1
    assert row["mode_adj_path"] == "stimulation→expression,mixed→custom,custom→7"
    assert (row["is_complete"], row["is_valid"], row["total_duration_sec"]) == (1, 1, 601)
    assert str(row["total_duration_min"]) == "10.02" and row["usedModeCount"] == 2 and row["finalSuctionLevel"] == "4"
    assert (row["start_time"], row["end_time"]) == (dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11))


def test_duplicates_orphans_and_edges(spark):
    def end(i, when, sid, sec, **extra):
        return log(i, when, "pump_session_end", sid, modeDuration=[{"durationSec": sec, "modeType": "m"}], **extra)

    logs = [
        log(1, "2024-01-01T10:00:00", "pump_session_start", "twice", uid="a"),
        log(2, "2024-01-01T10:05:00", "pump_session_start", "twice", uid="b"),
        end(3, "2024-01-01T10:10:00", "twice", 600),
        end(4, "2024-01-01T10:20:00", "twice", 900),
        log(5, "2024-01-01T10:00:00", "pump_session_start", "open"),
        end(6, "2024-01-01T10:20:00", "orphan", 50),
        log(7, "2024-01-01T10:00:00", "pump_session_start", "edge"),
        end(8, "2024-01-01T10:20:00", "edge", 600),
        log(9, "2024-01-01T23:59:00", "pump_session_start", "days"),
        log(10, "2024-01-02T00:01:00", "pump_session_start", "days"),
        end(11, "2024-01-02T00:20:00", "days", 700),
        log(12, None, "pump_session_start", "no time"),
        log(13, "2024-01-01T10:00:00", "pump_session_start", None),
        log(14, "2024-01-01T10:20:00", "pump_session_end", "days"),
    ]
    got = rows(
        build_sessions(events(spark, *logs)), "useSessionId", "evt_dt", "uid", "is_complete", "is_valid", "total_duration_sec"
    )
    one, two = D("2024-01-01"), D("2024-01-02")
    assert got == [
        ("days", one, "a", 1, 1, 700),  # one row per day, both with the last end
        ("days", two, "a", 1, 1, 700),
        ("edge", one, "a", 1, 0, 600),  # valid means longer than 600
        ("open", one, "a", 0, 0, None),
        ("twice", one, "b", 1, 1, 900),
    ]
    modes = rows(build_session_modes(events(spark, *logs)), "useSessionId", "evt_dt", "duration_sec")
    assert modes == [("days", two, 700), ("edge", one, 600), ("orphan", one, 50), ("twice", one, 900)]


def test_report_window(spark):
    logs = [
        log(1, "2024-01-01T10:00:00", "pump_session_start", "early", dt_="2024-01-01"),
        log(2, "2024-01-01T10:30:00", "pump_session_end", "early", dt_="2024-01-09"),
        log(3, "2024-01-01T10:00:00", "pump_session_start", "late", dt_="2024-01-02"),
        log(4, "2024-01-10T10:00:00", "pump_session_start", "future", dt_="2024-01-10"),
    ]
    got = rows(build_sessions(events(spark, *logs), "2024-01-09", 7), "useSessionId", "is_complete")
    assert got == [("late", 0)]  # the start of "early" lies outside, "future" is not reported yet


def test_mode_pairs(spark):
    def end(i, sid, text):
        return log(i, "2024-01-01T10:00:00", "pump_session_end", sid, modeDuration=text)

    logs = [
        end(1, "ok", '[{"durationSec": 30, "modeType": "x"}, {"modeType": "y", "durationSec": 40}]'),
        end(2, "empty", "[]"),
        end(3, "no mode", '[{"durationSec": 30}, {"durationSec": 40, "modeType": "y"}]'),
        end(4, "no time", '[{"modeType": "x"}]'),
        end(5, "again", '[{"durationSec": 1, "modeType": "x"}, {"durationSec": 2, "modeType": "x"}]'),
    ]
    got = rows(build_session_modes(events(spark, *logs)), "useSessionId", "modeType", "duration_sec", "duration_min")
    assert [(a, b, c, str(d)) for a, b, c, d in got] == [
        ("again", "x", 2, "0.03"),
        ("no mode", "y", 30, "0.50"),  # the i-th mode goes with the i-th duration
        ("ok", "x", 30, "0.50"),
        ("ok", "y", 40, "0.67"),
    ]


def test_hot_session_id(spark):
    """One id carried by a third of all events: whole path, exact counts."""
    logs = [log(0, "2024-01-01T00:00:00", "pump_session_start", "hot")]
    logs += [mode(i, f"2024-01-01T{i % 24:02d}:{i // 24 % 60:02d}:00", str(i % 3), "1", "hot") for i in range(1, 600)]
    for i in range(1200):
        logs.append(log(1000 + i, "2024-01-01T10:00:00", "pump_session_start", f"n{i}"))
    got = {r["useSessionId"]: r for r in build_sessions(events(spark, *logs)).collect()}
    assert len(got) == 1201 and got["hot"]["mode_adj_cnt"] == 599
    names = {"0": "stimulation", "1": "expression", "2": "mixed"}
    order = sorted(range(1, 600), key=lambda i: (i % 24, i // 24 % 60, i))
    assert got["hot"]["mode_adj_path"] == ",".join(f"{names[str(i % 3)]}→expression" for i in order)
