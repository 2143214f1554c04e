"""Column types of every table, as DDL strings for ``spark.read.schema``.

Counters are BIGINT: a total over a large fleet, or a damaged id shared by many rows, must not
overflow.
"""

import re

RAW = """
    id BIGINT, dt DATE, app STRING, appid STRING, writetime BIGINT, url STRING, traceid STRING,
    uid STRING, eventtype STRING, eventname STRING, content STRING, createtime BIGINT, data_source STRING
"""

EVENTS = """
    id BIGINT, dt DATE, app STRING, appid STRING, writetime BIGINT, url STRING, traceid STRING,
    uid STRING, eventtype STRING, content STRING, createtime BIGINT, data_source STRING,
    extraData STRING, eventName STRING, evtTimestamp BIGINT, useSessionId STRING,
    eventSessionId STRING, deviceCode STRING, deviceId STRING, os STRING, timezoneOffset STRING,
    evtType STRING, evtSource STRING, adjustFrom STRING, adjustTo STRING, finalModeType STRING,
    finalSuctionLevel STRING, modeDuration STRING, payload STRING, usedModeCount INT, endReason STRING,
    writetime_dt TIMESTAMP_NTZ, createtime_dt TIMESTAMP_NTZ, evtTimestamp_dt TIMESTAMP_NTZ, evt_dt DATE,
    evtTimestamp_local TIMESTAMP_NTZ, local_hour INT, is_weekday INT, adjust_direction STRING,
    total_duration_sec INT, pump_device_id STRING
"""

# One row per session, event day and hour: folded events, from which sessions can be finished at any time.
SESSION_HOURS = """
    useSessionId STRING, evt_dt DATE, hour BIGINT,
    start STRUCT<at: STRUCT<evtTimestamp: BIGINT, id: BIGINT>, evt_dt: DATE, uid: STRING, pump_device_id: STRING,
        deviceCode: STRING, os: STRING, evtTimestamp_local: TIMESTAMP_NTZ, local_hour: INT, is_weekday: INT>,
    end STRUCT<at: STRUCT<evtTimestamp: BIGINT, id: BIGINT>, evtTimestamp_local: TIMESTAMP_NTZ, total_duration_sec: INT,
        finalModeType: STRING, finalSuctionLevel: STRING, endReason: STRING, usedModeCount: INT>,
    mode_adj_cnt BIGINT, level_adj_cnt BIGINT, level_up_cnt BIGINT, level_down_cnt BIGINT, pause_cnt BIGINT,
    app_op_cnt BIGINT, manual_op_cnt BIGINT, path STRING
"""

SESSIONS = """
    evt_dt DATE, useSessionId STRING, uid STRING, pump_device_id STRING, deviceCode STRING, os STRING,
    start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, local_hour INT, is_weekday INT,
    total_duration_sec INT, total_duration_min DECIMAL(8,2), is_complete INT, is_valid INT,
    finalModeType STRING, finalSuctionLevel STRING, endReason STRING, usedModeCount INT,
    mode_adj_cnt BIGINT, mode_adj_path STRING, level_adj_cnt BIGINT, level_up_cnt BIGINT, level_down_cnt BIGINT,
    pause_cnt BIGINT, app_op_cnt BIGINT, manual_op_cnt BIGINT
"""

SESSION_MODES = """
    evt_dt DATE, useSessionId STRING, uid STRING, pump_device_id STRING, deviceCode STRING,
    modeType STRING, duration_sec INT, duration_min DECIMAL(8,2)
"""

DAILY = """
    evt_dt DATE, deviceCode STRING, dau BIGINT, active_devices BIGINT, new_users BIGINT, new_devices BIGINT,
    total_sessions BIGINT, complete_sessions BIGINT, valid_sessions BIGINT, power_on_cnt BIGINT,
    avg_sessions_per_user DECIMAL(8,2), total_duration_sec BIGINT, total_duration_h DECIMAL(12,2),
    avg_duration_min DECIMAL(8,2), avg_duration_per_user DECIMAL(8,2),
    start_rate DECIMAL(8,5), completion_rate DECIMAL(8,5), valid_rate DECIMAL(8,5),
    cumulative_users BIGINT, cumulative_devices BIGINT, cumulative_sessions BIGINT,
    cumulative_duration_h DECIMAL(16,2)
"""

RETENTION = """
    base_dt DATE, deviceCode STRING,
    base_users BIGINT, d1_retained_users BIGINT, d7_retained_users BIGINT, d14_retained_users BIGINT,
    d1_user_ret DECIMAL(8,5), d7_user_ret DECIMAL(8,5), d14_user_ret DECIMAL(8,5),
    base_devices BIGINT, d1_retained_devices BIGINT, d7_retained_devices BIGINT, d14_retained_devices BIGINT,
    d1_device_ret DECIMAL(8,5), d7_device_ret DECIMAL(8,5), d14_device_ret DECIMAL(8,5),
    new_users_base BIGINT, cohort_d1_ret DECIMAL(8,5), cohort_d7_ret DECIMAL(8,5), cohort_d14_ret DECIMAL(8,5)
"""

# Which ids were active on which days: one bit a day, 32 days a row.
ACTIVITY_BITS = """
    period INT, kind STRING, id STRING, deviceCode STRING, bits BIGINT
"""

# The first day of every user, device and session id with every model. Of an id's rows, is_new marks those of its very
# first day and is_one a single one of these.
FIRST_SEEN = """
    bucket INT, kind STRING, id STRING, deviceCode STRING, day DATE, is_new BOOLEAN, is_one BOOLEAN
"""

# On which days a session id has events, and whether it starts there.
SESSION_DAYS = """
    evt_dt DATE, bucket INT, useSessionId STRING, started BOOLEAN
"""

# What a day adds to the running totals.
INCREMENTS = """
    evt_dt DATE, deviceCode STRING, model_users BIGINT, new_users BIGINT, any_users BIGINT,
    model_devices BIGINT, new_devices BIGINT, any_devices BIGINT, model_sessions BIGINT, any_sessions BIGINT, seconds BIGINT
"""

# Session counts by key, split by the day on which the same session last had the key (with any model, with this one).
ROLLUPS = """
    evt_dt DATE, kind STRING, k1 STRING, k2 STRING, deviceCode STRING, prev_any DATE, prev_model DATE,
    sessions BIGINT, seconds BIGINT
"""

# What a nightly run is about to change, by the name of the run: days of events, of starts, of any rows of its sessions before
# it, and of moved first sightings.
RUN_DAYS = """
    run STRING, what STRING, day DATE
"""
RUN_IDS = """
    run STRING, useSessionId STRING
"""

USER_FLAGS = """
    uid STRING, country_ad_ch STRING, data_source STRING, active_status STRING, deleted STRING,
    event_date STRING, update_date STRING, act_flag STRING, device_vis_flag STRING, stat_vis_flag STRING,
    dynamic_vis_flag STRING, account_vis_flag STRING, member_vis_flag STRING, moment_act_flag STRING
"""

DEVICES = """
    device_id STRING, sn STRING, model STRING, type_id STRING, mac STRING, device_info STRING, status INT,
    create_time TIMESTAMP_NTZ, update_time TIMESTAMP_NTZ, last_login TIMESTAMP_NTZ, data_source STRING,
    device_name STRING
"""

# name -> (schema, partition columns, key columns)
TABLES = {
    "raw": (RAW, ["dt"], ["id", "dt"]),
    "events": (EVENTS, ["dt", "evt_dt"], ["id", "dt"]),
    "session_hours": (SESSION_HOURS, ["evt_dt"], ["useSessionId", "evt_dt", "hour"]),
    "sessions": (SESSIONS, ["evt_dt"], ["evt_dt", "useSessionId"]),
    "session_modes": (SESSION_MODES, ["evt_dt"], ["evt_dt", "useSessionId", "modeType"]),
    "daily": (DAILY, ["evt_dt"], ["evt_dt", "deviceCode"]),
    "retention": (RETENTION, ["base_dt"], ["base_dt", "deviceCode"]),
    "activity_bits": (ACTIVITY_BITS, ["period"], ["period", "kind", "id", "deviceCode"]),
    "first_seen": (FIRST_SEEN, ["bucket"], ["kind", "id", "deviceCode"]),
    "session_days": (SESSION_DAYS, ["evt_dt", "bucket"], ["useSessionId", "evt_dt"]),
    "increments": (INCREMENTS, ["evt_dt"], ["evt_dt", "deviceCode"]),
    "rollups": (ROLLUPS, ["evt_dt"], ["evt_dt", "kind", "k1", "k2", "deviceCode", "prev_any", "prev_model"]),
    "run_days": (RUN_DAYS, ["run"], ["run", "what", "day"]),
    "run_ids": (RUN_IDS, ["run"], ["run", "useSessionId"]),
    "user_flags": (USER_FLAGS, [], []),
    "devices": (DEVICES, [], []),
}


def _columns(ddl: str) -> list[list[str]]:
    return [column.split(None, 1) for column in re.split(r",(?![^(<]*[)>])", ddl)]


def column_names(ddl: str) -> list[str]:
    return [name for name, _ in _columns(ddl)]


def column_types(ddl: str) -> list[str]:
    return [kind.strip() for _, kind in _columns(ddl)]
