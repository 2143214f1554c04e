"""Independent SQL for every registered query, in DuckDB's dialect.

The statements restate the report definitions literally (per-day sets, correlated counts), not the way
the Spark jobs compute them. Rates are rounded in whole-number arithmetic.
"""

from __future__ import annotations

import re

from checks.params import (
    AS_OF_DEVICES,
    AS_OF_USERS,
    END,
    FIRMWARE_VERSIONS,
    FROM_DAY,
    MODEL,
    START,
    TO_DAY,
    USER_QUERY_COUNTRIES,
    USER_QUERY_SOURCES,
)


def rint(n: str, d: str, p: int) -> str:
    """n/d rounded half up to p decimals, as a whole number of 10^-p; NULL when d is 0. For n >= 0."""
    return (
        f"(CASE WHEN ({d}) <> 0 THEN (2 * CAST({n} AS HUGEINT) * {10**p} + CAST({d} AS HUGEINT))"
        f" // (2 * CAST({d} AS HUGEINT)) END)"
    )


def rdiv(n: str, d: str, p: int) -> str:
    return f"({rint(n, d, p)} / 1e{p})"


def even(x: str, p: int) -> str:
    """Half-even rounding; adding zero turns -0.0 into 0.0."""
    return f"(round_even({x}, {p}) + 0.0)"


MODE = "(CASE ({}) % 3 WHEN 0 THEN 'expression' WHEN 1 THEN 'massage' ELSE 'stimulation' END)"
CODE = "(CASE ({}) % 4 WHEN 0 THEN 'stimulation' WHEN 1 THEN 'expression' WHEN 2 THEN 'mixed' ELSE 'custom' END)"
FIRST, LAST = "DATE '2024-01-01'", "DATE '2024-01-30'"

CTES: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, needs: list[str], text: str) -> None:
    CTES[name], NEEDS[name] = text, needs


cte(
    "base",
    [],
    f"""
    SELECT event_id, k, d, date_trunc('second', ts) AS t, uid, model, os, hour, weekday, dur, 1 + k % 3 AS n_modes,
           CASE WHEN uid IS NULL THEN NULL ELSE uid || '-00' || (event_id % 2) END AS device
    FROM (
      SELECT *, CAST(ts AS DATE) AS d, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             CASE WHEN user_id % 17 = 0 THEN NULL
                  ELSE (CASE WHEN date_diff('day', {FIRST}, CAST(ts AS DATE)) < user_id % 25 THEN 'e' ELSE 'u' END) || user_id END AS uid,
             'D' || (user_id % 3) AS model,
             CASE WHEN event_id % 2 = 0 THEN 'iOS' ELSE 'Android' END AS os,
             CAST(hour(ts) AS BIGINT) AS hour,
             CASE WHEN dayofweek(ts) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS weekday,
             CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL
                  ELSE CAST(floor(value * 20) AS BIGINT) END AS dur
      FROM events)""",
)
cte(
    "sess",
    ["base"],
    f"""
    SELECT d AS evt_dt, CAST(event_id AS VARCHAR) AS sid, uid, device, model, os, t AS start_time,
           CASE WHEN dur IS NOT NULL THEN t END AS end_time, hour AS local_hour, weekday AS is_weekday,
           dur AS sec, CASE WHEN dur IS NULL THEN 0 ELSE 1 END AS is_complete,
           CASE WHEN dur > 600 THEN 1 ELSE 0 END AS is_valid,
           CASE WHEN dur IS NOT NULL THEN {MODE.format('event_id')} END AS final_mode,
           CASE WHEN dur IS NOT NULL THEN CAST(k % 14 AS VARCHAR) END AS final_level,
           CASE WHEN dur IS NULL THEN NULL WHEN k % 2 = 0 THEN 'user' ELSE 'timeout' END AS end_reason,
           CASE WHEN dur IS NOT NULL THEN n_modes END AS used_modes,
           k % 4 AS mode_adj, k % 13 AS level_adj, (k % 13) // 2 AS level_up, (k % 13) // 3 AS level_down,
           k % 5 AS pauses,
           CASE WHEN k % 2 = 0 THEN k % 4 + k % 13 ELSE 0 END AS app_ops,
           CASE WHEN k % 2 = 0 THEN 0 ELSE k % 4 + k % 13 END AS manual_ops,
           CASE k % 4 WHEN 0 THEN NULL
             WHEN 1 THEN {CODE.format('event_id')} || '→' || {CODE.format('event_id')}
             WHEN 2 THEN {CODE.format('event_id')} || '→' || {CODE.format('event_id')}
               || ',' || {CODE.format('event_id + 1')} || '→' || {CODE.format('event_id + 3')}
             ELSE {CODE.format('event_id')} || '→' || {CODE.format('event_id')}
               || ',' || {CODE.format('event_id + 1')} || '→' || {CODE.format('event_id + 3')}
               || ',' || {CODE.format('event_id + 2')} || '→' || {CODE.format('event_id + 6')} END AS path,
           k
    FROM base""",
)
cte(
    "modes",
    ["base"],
    f"""
    SELECT d AS evt_dt, CAST(event_id AS VARCHAR) AS sid, uid, device, model,
           {MODE.format('event_id + i')} AS mode_type,
           dur // n_modes + CASE WHEN i = n_modes - 1 THEN dur % n_modes ELSE 0 END AS sec
    FROM base, range(3) r(i) WHERE i < n_modes AND dur IS NOT NULL""",
)
cte(
    "dwd",
    ["base"],
    f"""
    SELECT event_id * 100 + n AS id, d + CAST(CASE WHEN event_id % 3 = 0 THEN k % 9 ELSE 0 END AS INTEGER) AS dt, n,
           epoch_ms(t) + n AS millis, base.*, name, type,
           CASE WHEN n IN (2, 90) THEN CASE WHEN event_id % 2 = 0 THEN 'remote_app' ELSE 'local_device' END
                WHEN n BETWEEN 3 AND 29 THEN CASE WHEN k % 2 = 0 THEN 'remote_app' ELSE 'manual' END END AS source,
           CASE type WHEN 'pump_mode' THEN CAST((event_id + n - 3) % 4 AS VARCHAR)
                     WHEN 'suction_level' THEN CAST(n - 9 AS VARCHAR) END AS adj_from,
           CASE type WHEN 'pump_mode' THEN CAST((event_id + 3 * (n - 3)) % 4 AS VARCHAR)
                     WHEN 'suction_level' THEN CAST(n - 9 + CASE
                        WHEN n - 10 < (k % 13) // 2 THEN 1
                        WHEN n - 10 < (k % 13) // 2 + (k % 13) // 3 THEN -1 ELSE 0 END AS VARCHAR) END AS adj_to
    FROM base, (
      SELECT n, CASE WHEN n < 2 THEN 'pump_startup_evt' WHEN n = 2 THEN 'pump_session_start'
                     WHEN n < 30 THEN 'pump_manual_adjust_evt' WHEN n < 90 THEN 'pump_user_evt'
                     ELSE 'pump_session_end' END AS name,
             CASE WHEN n BETWEEN 3 AND 9 THEN 'pump_mode' WHEN n BETWEEN 10 AND 29 THEN 'suction_level'
                  WHEN n BETWEEN 30 AND 89 THEN 'pause' END AS type
      FROM range(100) x(n)) e
    WHERE n = 0 OR (n = 1 AND k % 4 = 0) OR n = 2 OR (n BETWEEN 3 AND 9 AND n - 3 < k % 4)
       OR (n BETWEEN 10 AND 29 AND n - 10 < k % 13) OR (n BETWEEN 30 AND 89 AND n - 30 < k % 5)
       OR (n = 90 AND dur IS NOT NULL)""",
)


def daily_cte(power_by_model: bool) -> str:
    on = "evt_dt = g.evt_dt" + (" AND model = g.model" if power_by_model else "")
    upto = "s2.evt_dt <= g.evt_dt AND (s2.model = g.model OR g.model IS NULL)"
    return f"""
    SELECT *, {rint('sec', '3600', 2)} AS h_c, {rint('sec', '60 * sessions', 2)} AS adm_c,
           {rint('cum_sec', '3600', 2)} AS cum_h_c
    FROM (
      SELECT g.*,
        (SELECT count(*) FROM (
           SELECT uid FROM sess GROUP BY uid HAVING min(evt_dt) = g.evt_dt) f
         WHERE EXISTS (SELECT 1 FROM sess s2 WHERE s2.uid = f.uid AND s2.evt_dt = g.evt_dt AND s2.model = g.model))
          AS new_users,
        (SELECT count(*) FROM (
           SELECT device FROM sess GROUP BY device HAVING min(evt_dt) = g.evt_dt) f
         WHERE EXISTS (SELECT 1 FROM sess s2 WHERE s2.device = f.device AND s2.evt_dt = g.evt_dt
                       AND s2.model = g.model)) AS new_devices,
        (SELECT count(*) FROM (
           SELECT d AS evt_dt, model FROM base
           UNION ALL SELECT d, model FROM base WHERE k % 4 = 0) p WHERE {on}) AS power_on,
        (SELECT count(DISTINCT uid) FROM sess s2 WHERE {upto}) AS cum_users,
        (SELECT count(DISTINCT device) FROM sess s2 WHERE {upto}) AS cum_devices,
        (SELECT count(DISTINCT sid) FROM sess s2 WHERE {upto}) AS cum_sessions,
        (SELECT sum(sec) FROM sess s2 WHERE {upto}) AS cum_sec
      FROM (
        SELECT evt_dt, model, count(DISTINCT uid) AS dau, count(DISTINCT device) AS devices,
               count(DISTINCT sid) AS sessions, sum(is_complete) AS complete, sum(is_valid) AS valid, sum(sec) AS sec
        FROM sess GROUP BY evt_dt, model) g)"""


cte("daily", ["base", "sess"], daily_cte(False))
cte("daily_own", ["base", "sess"], daily_cte(True))


def _sets(key: str) -> str:
    where = "" if key == "uid" else f"WHERE {key} IS NOT NULL"
    return f"SELECT DISTINCT {key} AS id, evt_dt FROM sess {where}"


def _both(sets: str, a: str, b: str) -> str:
    return (
        f"(SELECT count(*) FROM {sets} x JOIN {sets} y ON x.id = y.id"
        f" WHERE x.evt_dt = {a} AND y.evt_dt = {b})"
    )


def _ret() -> str:
    parts = ["b.base_dt"]
    for sets, who in (("ud", "users"), ("dd", "devices")):
        for n in (1, 7, 14):
            parts.append(f"(SELECT count(*) FROM {sets} WHERE evt_dt = base_dt - {n}) AS b{n}_{who}")
            parts.append(f"{_both(sets, f'base_dt - {n}', 'base_dt')} AS r{n}_{who}")
    parts.append("(SELECT count(*) FROM fu WHERE first_dt = base_dt) AS new_users")
    for n in (1, 7, 14):
        parts.append(
            f"(SELECT count(*) FROM fu JOIN ud ON fu.id = ud.id WHERE first_dt = base_dt"
            f" AND evt_dt = base_dt + {n}) AS c{n}"
        )
    rates = []
    for who, one in (("users", "user"), ("devices", "device")):
        rates += [f"{rint(f'r{n}_{who}', f'b{n}_{who}', 5)} AS d{n}_{one}_e5" for n in (1, 7, 14)]
    return f"""
    SELECT *, {', '.join(rates)} FROM (
      SELECT {', '.join(parts)}
      FROM (SELECT {FIRST} + CAST(i AS INTEGER) AS base_dt FROM range(30) r(i)) b)"""


cte("ud", ["sess"], _sets("uid"))
cte("dd", ["sess"], _sets("device"))
cte("fu", ["sess"], "SELECT uid AS id, min(evt_dt) AS first_dt FROM sess GROUP BY uid")
cte("ret", ["sess", "ud", "dd", "fu"], _ret())
cte(
    "uflag",
    [],
    """
    SELECT CAST(o_custkey AS VARCHAR) AS uid, n_name AS country,
           CASE r_name WHEN 'AMERICA' THEN 'EC' WHEN 'EUROPE' THEN 'EU' ELSE 'AP' END AS source,
           CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS active_status,
           CASE WHEN o_orderkey % 23 = 0 THEN '1' ELSE '0' END AS deleted,
           CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
           strftime(o_orderdate, '%Y-%m-%d') AS update_date, o_orderkey AS ok
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "dev",
    [],
    """
    SELECT CAST(event_id AS VARCHAR) AS device_id, 'SN' || event_id AS sn, event_type AS model,
           'T' || (event_id % 4) AS type_id, 'mac-' || event_id AS mac,
           CASE WHEN k <> 99 THEN CAST(k % 7 AS VARCHAR) END AS version, 1 + event_id % 2 AS status, ts,
           CASE user_id % 4 WHEN 0 THEN 'EC' WHEN 1 THEN 'EU' WHEN 2 THEN 'AP' ELSE 'XX' END AS source,
           'device ' || event_id AS name
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
)


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    head = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    extra = body.strip()
    if extra.upper().startswith("WITH "):
        return f"WITH {head},\n{extra[5:]}"
    return f"WITH {head}\n{extra}"


def big(*names: str) -> str:
    """'a', 'b:c' -> CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS c."""
    out = []
    for name in names:
        src, _, alias = name.partition(":")
        out.append(f"CAST({src} AS BIGINT) AS {alias or src}")
    return ", ".join(out)


RANGE = f"evt_dt BETWEEN DATE '{START}' AND DATE '{END}'"
BASE_RANGE = f"base_dt BETWEEN DATE '{START}' AND DATE '{END}'"
OWN = f"{RANGE} AND model = '{MODEL}'"
Q: dict[str, str] = {}

# ---- marts ----------------------------------------------------------------------------------------

_EVENTS = (
    """
    SELECT id, dt, 'demo' AS app, 'a1' AS appid, epoch_ms(dt) + n AS writetime, CAST(NULL AS VARCHAR) AS url,
      CAST(NULL AS VARCHAR) AS traceid, uid, 'custom' AS eventtype, epoch_ms(dt) + n + 1 AS createtime,
      'EC' AS data_source, name AS eventName, millis AS evtTimestamp, CAST(event_id AS VARCHAR) AS useSessionId,
      's' || event_id AS eventSessionId, model AS deviceCode, 'phone' AS deviceId, os, 'GMT+0' AS timezoneOffset,
      type AS evtType, source AS evtSource, adj_from AS adjustFrom, adj_to AS adjustTo,
      CASE WHEN n = 90 THEN """
    + MODE.format("event_id")
    + """ END AS finalModeType,
      CASE WHEN n = 90 THEN CAST(k % 14 AS VARCHAR) END AS finalSuctionLevel,
      CASE WHEN n = 90 THEN '[' || (
        SELECT string_agg('{"durationSec":' || sec || ',"modeType":"' || mode_type || '"}', ',' ORDER BY i)
        FROM (SELECT i, dwd.dur // dwd.n_modes + CASE WHEN i = dwd.n_modes - 1 THEN dwd.dur % dwd.n_modes ELSE 0 END AS sec,
                     """
    + MODE.format("dwd.event_id + i")
    + """ AS mode_type FROM range(3) r(i) WHERE i < dwd.n_modes)) || ']' END AS modeDuration,
      '00000000-00' || (event_id % 2) AS payload,
      CAST(CASE WHEN n = 90 THEN n_modes END AS BIGINT) AS usedModeCount,
      CASE WHEN n = 90 THEN CASE WHEN k % 2 = 0 THEN 'user' ELSE 'timeout' END END AS endReason,
      CAST(dt AS TIMESTAMP) AS writetime_dt, CAST(dt AS TIMESTAMP) AS createtime_dt, t AS evtTimestamp_dt, d AS evt_dt,
      t AS evtTimestamp_local, hour AS local_hour, CAST(weekday AS BIGINT) AS is_weekday,
      CASE WHEN type = 'suction_level' THEN CASE WHEN CAST(adj_to AS INT) > CAST(adj_from AS INT) THEN 'up'
           WHEN CAST(adj_to AS INT) < CAST(adj_from AS INT) THEN 'down' ELSE 'same' END END AS adjust_direction,
      CASE WHEN n = 90 THEN dur END AS total_duration_sec, device AS pump_device_id
    FROM dwd"""
)
# The JSON texts, put together again from the fields in the order in which the log writes them; empty fields are left out.
_FIELDS = ["evtType", "evtSource", "adjustFrom", "adjustTo", "finalModeType", "finalSuctionLevel"]
_TEXT = "coalesce(',\"{0}\":\"' || {0} || '\"', '')"
_EXTRA = " || ".join(
    [
        """'{"eventName":"' || eventName || '","evtTimestamp":' || evtTimestamp || ',"useSessionId":"' || useSessionId""",
        """'","deviceCode":"' || deviceCode || '","payload":"' || payload || '"'""",
        *[_TEXT.format(name) for name in _FIELDS],
        """coalesce(',"modeDuration":' || modeDuration, '') || coalesce(',"usedModeCount":' || usedModeCount, '')""",
        _TEXT.format("endReason") + " || '}'",
    ]
)
_REST = """',"eventSessionId":"' || eventSessionId || '","deviceId":"phone","os":"' || os || '","timezoneOffset":"GMT+0"}'"""
_EXPLODED = f"""
    SELECT *, '{{"extraData":' || CASE WHEN CAST(useSessionId AS BIGINT) % 2 = 0 THEN extraData
      ELSE '"' || replace(extraData, '"', chr(92) || '"') || '"' END || {_REST} AS content
    FROM (SELECT *, {_EXTRA} AS extraData FROM ({_EVENTS}))"""
Q["m1_event_explode"] = sql(_EXPLODED, "dwd")
Q["w1_upsert_two_loads"] = sql(
    f"""SELECT * EXCLUDE (writetime, writetime_dt) REPLACE (CASE WHEN id % 3 = 0 THEN 'resent' ELSE eventName END AS eventName)
    FROM ({_EXPLODED})""",
    "dwd",
)
_SESSIONS = f"""
    SELECT evt_dt, sid AS useSessionId, uid, device AS pump_device_id, model AS deviceCode, os, start_time, end_time,
      local_hour, {big('is_weekday')}, sec AS total_duration_sec, {rdiv('sec', '60', 2)} AS total_duration_min,
      {big('is_complete', 'is_valid')}, final_mode AS finalModeType, final_level AS finalSuctionLevel,
      end_reason AS endReason, {big('used_modes:usedModeCount', 'mode_adj:mode_adj_cnt')}, path AS mode_adj_path,
      {big('level_adj:level_adj_cnt', 'level_up:level_up_cnt', 'level_down:level_down_cnt', 'pauses:pause_cnt',
           'app_ops:app_op_cnt', 'manual_ops:manual_op_cnt')}
    FROM sess"""
# All events of a test session are reported on the day of its start event.
_REPORTED = "SELECT CAST(event_id AS VARCHAR) FROM dwd WHERE n = 2 AND dt"
Q["m2_session_build"] = sql(_SESSIONS, "sess")
# The window 2024-01-21..2024-01-28 of report days: late rows of older event days take part too.
Q["m2_session_window"] = sql(
    f"{_SESSIONS} WHERE sid IN ({_REPORTED} BETWEEN DATE '2024-01-21' AND DATE '2024-01-28')", "sess", "dwd"
)
Q["m2_touched_rebuild"] = sql(
    f"""{_SESSIONS} WHERE sid IN ({_REPORTED} <= DATE '2024-01-28')
    AND evt_dt IN (SELECT d FROM dwd WHERE n = 2 AND dt BETWEEN DATE '2024-01-26' AND DATE '2024-01-28')""",
    "sess",
    "dwd",
)
Q["w2_chain_two_runs"] = sql(
    f"{_SESSIONS} WHERE sid IN ({_REPORTED} BETWEEN DATE '2024-01-27' AND DATE '2024-01-28')", "sess", "dwd"
)
_MODES = f"""
    SELECT evt_dt, sid AS useSessionId, uid, device AS pump_device_id, model AS deviceCode, mode_type AS modeType,
      {big('sec:duration_sec')}, {rdiv('sec', '60', 2)} AS duration_min FROM modes"""
Q["m3_session_modes"] = sql(_MODES, "modes")


def _daily(name: str, where: str = "TRUE") -> str:
    return sql(
        f"""
    SELECT evt_dt, model AS deviceCode,
      {big('dau', 'devices:active_devices', 'new_users', 'new_devices', 'sessions:total_sessions',
           'complete:complete_sessions', 'valid:valid_sessions', 'power_on:power_on_cnt')},
      {rdiv('sessions', 'dau', 2)} AS avg_sessions_per_user, {big('sec:total_duration_sec')},
      h_c / 1e2 AS total_duration_h, adm_c / 1e2 AS avg_duration_min,
      {rdiv('sec', '60 * dau', 2)} AS avg_duration_per_user, {rdiv('sessions', 'power_on', 5)} AS start_rate,
      {rdiv('complete', 'sessions', 5)} AS completion_rate, {rdiv('valid', 'sessions', 5)} AS valid_rate,
      {big('cum_users:cumulative_users', 'cum_devices:cumulative_devices', 'cum_sessions:cumulative_sessions')},
      cum_h_c / 1e2 AS cumulative_duration_h
    FROM {name} WHERE {where}""",
        name,
    )


Q["m4_daily"] = _daily("daily")
Q["m4_daily_power_by_model"] = _daily("daily_own")
Q["m4_cumulative"] = sql(
    f"""
    SELECT evt_dt, model AS deviceCode, {big('new_users', 'new_devices', 'cum_users:cumulative_users',
      'cum_devices:cumulative_devices', 'cum_sessions:cumulative_sessions', 'cum_sec:cumulative_sec')} FROM daily""",
    "daily",
)


def _retention(where: str) -> str:
    rates = ", ".join(
        f"d{n}_{one}_e5 / 1e5 AS d{n}_{one}_ret" for one in ("user", "device") for n in (1, 7, 14)
    )
    cohort = ", ".join(f"{rdiv(f'c{n}', 'new_users', 5)} AS cohort_d{n}_ret" for n in (1, 7, 14))
    counts = big(
        "b1_users:base_users",
        *[f"r{n}_users:d{n}_retained_users" for n in (1, 7, 14)],
        "b1_devices:base_devices",
        *[f"r{n}_devices:d{n}_retained_devices" for n in (1, 7, 14)],
        "new_users:new_users_base",
    )
    return sql(f"SELECT base_dt, 'ALL' AS deviceCode, {counts}, {rates}, {cohort} FROM ret WHERE {where}", "ret")


Q["m5_retention"] = _retention("TRUE")
Q["m5_retention_from_bits"] = Q["m5_retention"]
Q["m4_cumulative_from_increments"] = Q["m4_cumulative"]
Q["w2_nightly_sessions"] = Q["m2_session_build"]
Q["w2_nightly_modes"] = Q["m3_session_modes"]
Q["w2_nightly_daily"] = Q["m4_daily"]
Q["w2_nightly_retention"] = Q["m5_retention"]
Q["m_chain_from_raw_log"] = Q["m5_retention"]
Q["m_chain_daily_from_raw_log"] = Q["m4_daily"]
Q["m_chain_modes_from_raw_log"] = Q["m3_session_modes"]
Q["w3_retention_backfill"] = _retention(f"base_dt > {LAST} - 15")
Q["w1_latest_by_key"] = sql(
    "SELECT id, dt, CASE WHEN id % 3 = 0 THEN 'resent' ELSE name END AS eventName FROM dwd", "dwd"
)

# ---- KPIs -----------------------------------------------------------------------------------------

Q["k0_device_codes"] = sql("SELECT DISTINCT model AS deviceCode FROM sess", "sess")
_K1 = f"""
    SELECT {big('u:total_users', 'dv:total_devices', 's:total_sessions')}, {rdiv('s', 'u', 0)} AS avg_sessions_per_user,
      {rdiv('v', 's', 5)} AS valid_session_rate_pct, h / 1e2 AS total_duration_hours,
      {rdiv('sec', '60 * s', 2)} AS avg_duration_min, {rdiv('dv', 'u', 4)} AS devices_per_user
    FROM (SELECT max(cum_users) AS u, max(cum_devices) AS dv, sum(sessions) AS s, sum(valid) AS v, sum(h_c) AS h,
            sum(sec) AS sec FROM daily WHERE {{}})"""
Q["k1_overview_totals"] = sql(_K1.format(RANGE), "daily")
Q["k1_overview_totals_model"] = sql(_K1.format(OWN), "daily")
_K2 = f"SELECT sum(power_on) AS po, max(cum_devices) AS dv, sum(sessions) AS s, sum(complete) AS c, sum(valid) AS v FROM daily WHERE {RANGE}"
Q["k2_funnel_totals"] = sql(
    f"SELECT {big('po:power_on_cnt', 'dv:total_devices', 's:started_sessions', 'c:ended_sessions', 'v:valid_sessions')} FROM ({_K2})",
    "daily",
)
Q["k3_mean_d1_retention"] = sql(
    f"SELECT {rdiv('sum(d1_user_e5)', 'count(d1_user_e5) * 100000', 5)} AS d1_user_ret FROM ret WHERE {BASE_RANGE}",
    "ret",
)


def _snapshot(day: str) -> str:
    return f"""
      SELECT {big('sum(dau):dau', 'sum(devices):active_devices', 'sum(new_users):new_users',
                  'sum(new_devices):new_devices', 'sum(sessions):sessions')},
        CAST(sum(h_c) AS DOUBLE) / 1e2 AS duration_hours,
        {rdiv('sum(adm_c * sessions)', '100 * sum(sessions)', 2)} AS avg_dur_min,
        {rdiv('sum(valid)', 'sum(sessions)', 5)} AS valid_rate,
        {rdiv('sum(sessions)', 'sum(dau)', 2)} AS avg_sessions_per_user,
        {rdiv('sum(sec)', '60 * sum(dau)', 2)} AS dur_per_user_min,
        {big('sum(power_on):power_on_cnt', 'sum(complete):complete_sessions', 'sum(valid):valid_sessions')}
      FROM daily WHERE evt_dt = (SELECT max(evt_dt) FROM daily WHERE evt_dt <= {day})"""


def _week(end: str, model: str | None) -> str:
    own = f"AND model = '{model}'" if model else ""
    digits = {
        "dau": 0, "active_devices": 0, "new_users": 0, "new_devices": 0, "sessions": 0, "duration_hours": 2,
        "avg_dur_min": 2, "valid_rate": 5, "avg_sessions_per_user": 2, "dur_per_user_min": 2, "power_on_cnt": 0,
        "complete_sessions": 0, "valid_sessions": 0,
    }
    return f"""
      SELECT {', '.join(f'round(avg(CAST({n} AS DOUBLE)) + 1e-9, {d}) AS {n}' for n, d in digits.items())}
      FROM (SELECT evt_dt, sum(dau) AS dau, sum(devices) AS active_devices, sum(new_users) AS new_users,
              sum(new_devices) AS new_devices, sum(sessions) AS sessions, CAST(sum(h_c) AS DOUBLE) / 1e2 AS duration_hours,
              CAST(sum(adm_c * sessions) AS DOUBLE) / CAST(100 * sum(sessions) AS DOUBLE) AS avg_dur_min,
              CAST(sum(valid) AS DOUBLE) / CAST(sum(sessions) AS DOUBLE) AS valid_rate,
              CAST(sum(sessions) AS DOUBLE) / nullif(CAST(sum(dau) AS DOUBLE), 0) AS avg_sessions_per_user,
              CAST(sum(sec) AS DOUBLE) / nullif(CAST(60 * sum(dau) AS DOUBLE), 0) AS dur_per_user_min,
              sum(power_on) AS power_on_cnt, sum(complete) AS complete_sessions, sum(valid) AS valid_sessions
            FROM daily WHERE evt_dt BETWEEN {end} - 6 AND {end} {own} GROUP BY evt_dt)"""


E = f"DATE '{END}'"
GAP = "DATE '2024-02-02'"  # past the last day with data
Q["k4_daily_snapshot"] = sql(_snapshot(E), "daily")
Q["k4_daily_snapshot_as_of"] = sql(_snapshot(GAP), "daily")
Q["k4b_seven_day_mean"] = sql(_week(E, None), "daily")
Q["k4b_seven_day_mean_model"] = sql(_week(GAP, MODEL), "daily")


def _pct(new: str, old: str) -> str:
    return f"CASE WHEN {old} <> 0 THEN {even(f'(CAST({new} AS DOUBLE) - {old}) / abs({old}) * 100', 1)} END"


def _pp(new: str, old: str) -> str:
    return even(f"(CAST({new} AS DOUBLE) - {old}) * 100", 1)


def _cmp(out: str, name: str, points: bool = False) -> str:
    f = _pp if points else _pct
    return f"{f(f'n.{name}', f'p.{name}')} AS {out}_d1_delta, {f(f'n.{name}', f'w.{name}')} AS {out}_d7_delta"


def _three(end: str, model: str | None = None) -> str:
    return f"n AS ({_snapshot(end)}), p AS ({_snapshot(end + ' - 1')}), w AS ({_week(end + ' - 1', model)})"


_RATES = ["d1_user", "d7_user", "d1_device", "d7_device"]


def _rates(end: str, bounded: bool) -> str:
    cols = ", ".join(f"{c}_e5 / 1e5 AS {c}" for c in _RATES)
    means = ", ".join(f"{rdiv(f'sum({c}_e5)', f'count({c}_e5) * 100000', 5)} AS {c}" for c in _RATES)
    now = f"WHERE base_dt <= {end}" if bounded else ""
    past = f"WHERE base_dt <= {end} - 1"
    return f"""
      rn AS (SELECT {cols} FROM ret {now} ORDER BY base_dt DESC LIMIT 1),
      rp AS (SELECT {cols} FROM ret {past} ORDER BY base_dt DESC LIMIT 1),
      rw AS (SELECT {means} FROM (SELECT * FROM ret {past} ORDER BY base_dt DESC LIMIT 7))"""


def _k5(model: str | None) -> str:
    return sql(
        f"""
    WITH {_three(E, model)}, {_rates(E, False)}
    SELECT n.dau, n.active_devices, n.sessions, n.duration_hours, n.avg_dur_min,
      {even('rn.d1_user * 100', 1)} AS d1_ret, n.valid_rate,
      {_cmp('dau', 'dau')}, {_cmp('active_devices', 'active_devices')}, {_cmp('sessions', 'sessions')},
      {_cmp('duration_hours', 'duration_hours')},
      {_pp('rn.d1_user', 'rp.d1_user')} AS d1_ret_d1_delta, {_pp('rn.d1_user', 'rw.d1_user')} AS d1_ret_d7_delta,
      {_cmp('valid_rate', 'valid_rate', True)}
    FROM n, p, w, rn, rp, rw""",
        "daily",
        "ret",
    )


Q["k5_yesterday_card"] = _k5(None)
Q["k5_yesterday_card_model"] = _k5(MODEL)
_rate_cmp = ", ".join(
    f"{_pp(f'rn.{c}', f'rp.{c}')} AS {c}_d1_delta, {_pp(f'rn.{c}', f'rw.{c}')} AS {c}_d7_delta" for c in _RATES
)
Q["k6_retention_summary"] = sql(
    f"""
    WITH {_three(E)}, {_rates(E, True)},
      a AS (SELECT {', '.join(f"{rdiv(f'sum({c}_e5)', f'count({c}_e5) * 100000', 5)} AS {c}" for c in _RATES)}
            FROM ret WHERE {BASE_RANGE}),
      x AS (SELECT round(avg(u), 0) AS avg_dau, round(avg(v), 0) AS avg_devices
            FROM (SELECT sum(dau) AS u, sum(devices) AS v FROM daily WHERE {RANGE} GROUP BY evt_dt))
    SELECT x.avg_dau, x.avg_devices, {', '.join(f'rn.{c} AS {c}_pct' for c in _RATES)},
      {', '.join(f'a.{c} AS avg_{c}_pct' for c in _RATES)}, n.new_users AS new_users_yday, n.new_devices AS new_devices_yday,
      {_cmp('dau', 'dau')}, {_rate_cmp}, n.dau AS dau_yday, {_cmp('new_users', 'new_users')},
      {_cmp('new_devices', 'new_devices')}
    FROM n, p, w, rn, rp, rw, a, x""",
    "daily",
    "ret",
)
_UD = "SELECT evt_dt, uid, count(DISTINCT sid) AS n FROM sess WHERE {} AND uid IS NOT NULL GROUP BY evt_dt, uid"
Q["k7_sessions_summary"] = sql(
    f"""
    WITH {_three(E)}, z AS ({_UD.format(RANGE)})
    SELECT (SELECT {rdiv('sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)', 'count(*)', 4)} FROM z) AS one_per_day_pct,
      (SELECT max(n) FROM z) AS max_sessions_single_user,
      {_cmp('sessions', 'sessions')}, {_cmp('avg_sessions_per_user', 'avg_sessions_per_user')},
      CAST(NULL AS DOUBLE) AS max_sessions_d1_delta, CAST(NULL AS DOUBLE) AS max_sessions_d7_delta,
      CAST(NULL AS DOUBLE) AS one_per_day_d1_delta, CAST(NULL AS DOUBLE) AS one_per_day_d7_delta
    FROM n, p, w""",
    "daily",
)
_ONE = f"SELECT {rdiv('sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)', 'count(*)', 4)} AS one, max(n) AS most FROM ({{}})"


def _k8(end: str, model: str | None) -> str:
    own = f" AND model = '{model}'" if model else ""
    at = "evt_dt = (SELECT max(evt_dt) FROM daily WHERE evt_dt <= {})" + own
    week = f"evt_dt BETWEEN {end} - 7 AND {end} - 1" + own
    return sql(
        f"""
    WITH {_three(end, model)}, o1 AS ({_ONE.format(_UD.format(at.format(end)))}),
      o2 AS ({_ONE.format(_UD.format(at.format(end + ' - 1')))}),
      o7 AS (SELECT round(avg(r) + 1e-9, 4) AS one FROM (
        SELECT evt_dt, CAST(count(CASE WHEN n = 1 THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS r
        FROM ({_UD.format(week)}) GROUP BY evt_dt))
    SELECT n.sessions AS total_sessions, n.avg_sessions_per_user, o1.one AS one_per_day_pct,
      o1.most AS max_sessions_single_user, {_cmp('sessions', 'sessions')},
      {_cmp('avg_sessions_per_user', 'avg_sessions_per_user')}, {_pp('o1.one', 'o2.one')} AS one_per_day_d1_delta,
      {_pp('o1.one', 'o7.one')} AS one_per_day_d7_delta
    FROM n, p, w, o1, o2, o7""",
        "daily",
    )


Q["k8_sessions_yesterday"] = _k8(E, None)
Q["k8_sessions_yesterday_model"] = _k8(GAP, MODEL)
Q["k9_duration_summary"] = sql(
    f"""
    WITH {_three(E)}, x AS (SELECT CAST(sum(h_c) AS DOUBLE) / 1e2 AS total_duration_hours,
        {rdiv('sum(adm_c * sessions)', '100 * sum(sessions)', 2)} AS avg_duration_min,
        {rdiv('sum(sec)', '60 * sum(dau) * count(DISTINCT evt_dt)', 2)} AS daily_min_per_user,
        {rdiv('sum(valid)', 'sum(sessions)', 5)} AS valid_session_rate_pct FROM daily WHERE {RANGE})
    SELECT x.*, {_cmp('total_hours', 'duration_hours')}, {_cmp('avg_dur_min', 'avg_dur_min')},
      {_cmp('dur_per_user', 'dur_per_user_min')}, {_cmp('valid_rate', 'valid_rate', True)}
    FROM n, p, w, x""",
    "daily",
)
Q["k10_duration_yesterday"] = sql(
    f"""
    SELECT duration_hours AS total_hours_yday, avg_dur_min AS avg_dur_min_yday,
      dur_per_user_min AS daily_per_user_yday, valid_rate AS valid_rate_yday FROM ({_snapshot(E)})""",
    "daily",
)
Q["k11_adjust_summary"] = sql(
    f"""
    SELECT {even('m / CAST(n AS DOUBLE) * 100', 1)} AS mode_adj_rate_pct,
      {even('l / CAST(n AS DOUBLE) * 100', 1)} AS level_adj_rate_pct,
      {rdiv('sm', 'n', 2)} AS avg_mode_adj, {rdiv('sl', 'n', 2)} AS avg_level_adj
    FROM (SELECT count(DISTINCT sid) AS n, count(DISTINCT CASE WHEN mode_adj > 0 THEN sid END) AS m,
            count(DISTINCT CASE WHEN level_adj > 0 THEN sid END) AS l, sum(mode_adj) AS sm, sum(level_adj) AS sl
          FROM sess WHERE {RANGE})""",
    "sess",
)
Q["k12_pause_stats"] = sql(
    f"""
    WITH x AS (SELECT count(*) AS n, count(CASE WHEN pauses > 0 THEN 1 END) AS p, sum(pauses) AS s,
        count(CASE WHEN pauses = 0 THEN 1 END) AS c0, count(CASE WHEN pauses = 1 THEN 1 END) AS c1,
        count(CASE WHEN pauses = 2 THEN 1 END) AS c2, count(CASE WHEN pauses >= 3 THEN 1 END) AS c3
      FROM sess WHERE {RANGE})
    SELECT l AS pauses, {rdiv('p * 100', 'n', 1)} AS pause_rate_pct, {rdiv('s', 'p', 1)} AS avg_pauses,
      {even('c / CAST(n AS DOUBLE) * 100', 1)} AS pct
    FROM (SELECT '0' AS l, c0 AS c, * FROM x UNION ALL SELECT '1', c1, * FROM x
          UNION ALL SELECT '2', c2, * FROM x UNION ALL SELECT '3+', c3, * FROM x)""",
    "sess",
)
Q["k13_funnel_rates"] = sql(
    f"""
    SELECT {big('po:power_on_cnt', 's:started_sessions', 'c:ended_sessions', 'v:valid_sessions')},
      {even('s * 100 / CAST(po AS DOUBLE)', 1)} AS start_rate_pct,
      {even('c * 100 / CAST(s AS DOUBLE)', 1)} AS completion_rate_pct,
      {even('v * 100 / CAST(s AS DOUBLE)', 1)} AS valid_rate_pct FROM ({_K2})""",
    "daily",
)

# ---- trends ---------------------------------------------------------------------------------------


def _trend(columns: str, where: str = RANGE) -> str:
    return sql(f"SELECT evt_dt AS dt, {columns} FROM daily WHERE {where} GROUP BY evt_dt", "daily")


Q["t1_active_trend"] = _trend(big("sum(dau):dau", "sum(devices):active_devices"))
Q["t2_session_trend"] = _trend(big("sum(sessions):session_count"))
Q["t3_session_trend_model"] = _trend(big("sum(sessions):session_count"), OWN)
Q["t4_sessions_per_user_trend"] = _trend(f"{rdiv('sum(sessions)', 'sum(dau)', 2)} AS avg_sessions")
Q["t5_newcomer_trend"] = _trend(big("sum(new_users):new_users", "sum(new_devices):new_devices"))
for _key, _one in (("t6", "user"), ("t7", "device")):
    Q[f"{_key}_{_one}_retention_trend"] = sql(
        f"""SELECT base_dt AS base_date, d1_{_one}_e5 / 1e5 AS d1_{_one}_retention_pct,
          d7_{_one}_e5 / 1e5 AS d7_{_one}_retention_pct FROM ret WHERE {BASE_RANGE}""",
        "ret",
    )
Q["t8_hours_trend"] = _trend("CAST(sum(h_c) AS DOUBLE) / 1e2 AS total_hours")
Q["t9_minutes_per_user_trend"] = _trend(f"{rdiv('sum(sec)', '60 * sum(dau)', 2)} AS avg_min_per_user")
Q["t10_mean_duration_trend"] = _trend(
    f"{rdiv('sum(adm_c * sessions)', '100 * sum(sessions)', 2)} AS avg_duration_min"
)
Q["t11_cumulative_hours_trend"] = _trend(
    f"CAST(sum(h_c) AS DOUBLE) / 1e2 AS daily_hours, {rdiv('max(cum_h_c)', '100000', 3)} AS cumulative_hours_k"
)
Q["t12_funnel_trend"] = _trend(
    big("sum(power_on):power_on_cnt", "sum(sessions):started_cnt", "sum(complete):ended_cnt", "sum(valid):valid_cnt"),
    f"evt_dt BETWEEN {E} - 29 AND {E}",
)
Q["t13_funnel_rate_trend"] = _trend(
    f"{rdiv('sum(complete) * 100', 'sum(sessions)', 2)} AS completion_rate_pct,"
    f" {rdiv('sum(valid) * 100', 'sum(complete)', 2)} AS valid_rate_pct",
    f"evt_dt BETWEEN {E} - 29 AND {E}",
)
Q["t14_user_day_bucket_trend"] = sql(
    f"""
    SELECT dt, session_bucket, cnt_of_day,
      {rdiv('cnt_of_day', 'sum(cnt_of_day) OVER (PARTITION BY dt)', 4)} AS pct_of_day
    FROM (SELECT evt_dt AS dt, CASE WHEN n <= 3 THEN CAST(n AS VARCHAR) WHEN n <= 5 THEN '4-5' ELSE '6+' END
            AS session_bucket, count(*) AS cnt_of_day FROM ({_UD.format(RANGE)}) GROUP BY 1, 2)""",
    "sess",
)
Q["t15_mode_session_trend"] = sql(
    f"""
    SELECT dt, mode_type, cnt, {rdiv('cnt', 'sum(cnt) OVER (PARTITION BY dt)', 5)} AS pct
    FROM (SELECT evt_dt AS dt, mode_type, count(DISTINCT sid) AS cnt FROM modes WHERE {RANGE} GROUP BY 1, 2)""",
    "modes",
)
Q["t16_mode_minutes_trend"] = sql(
    f"""
    SELECT dt, mode_type, {rdiv('s', '60', 2)} AS dur_min, {rdiv('s', 'sum(s) OVER (PARTITION BY dt)', 5)} AS pct
    FROM (SELECT evt_dt AS dt, mode_type, sum(sec) AS s FROM modes WHERE {RANGE} GROUP BY 1, 2)""",
    "modes",
)

# ---- distributions --------------------------------------------------------------------------------


def _dist(select: str, count: str, digits: int, source: str, part: str = "", pct: str = "pct") -> str:
    """select: grouped columns and ``c``; adds the share of ``c``."""
    over = f"OVER (PARTITION BY {part})" if part else "OVER ()"
    return f"SELECT * RENAME (c AS {count}), {rdiv('c', f'sum(c) {over}', digits)} AS {pct} FROM ({select} {source})"


LEVEL = """CASE WHEN CAST(final_level AS INT) BETWEEN 1 AND 3 THEN '1-3' WHEN CAST(final_level AS INT) BETWEEN 4 AND 6
  THEN '4-6' WHEN CAST(final_level AS INT) BETWEEN 7 AND 9 THEN '7-9' ELSE '9+' END"""
LEVEL_ORDER = LEVEL.replace("'1-3'", "1").replace("'4-6'", "2").replace("'7-9'", "3").replace("'9+'", "4")
TOTAL = """CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20'
  WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '100+' END"""
TOTAL_ORDER = """CASE WHEN n = 1 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 6 WHEN n <= 20 THEN 11
  WHEN n <= 50 THEN 21 WHEN n <= 100 THEN 51 ELSE 101 END"""

for _suffix, _where in (("", RANGE), ("_model", OWN)):
    Q[f"b1_final_modes{_suffix}"] = sql(
        _dist(
            "SELECT final_mode AS mode_type, count(DISTINCT sid) AS c", "session_count", 5,
            f"FROM sess WHERE {_where} AND final_mode IS NOT NULL GROUP BY 1",
        ),
        "sess",
    )
Q["b2_suction_levels"] = sql(
    _dist(
        f"SELECT {LEVEL} AS level_bucket, {big(f'{LEVEL_ORDER}:bucket_order')}, count(DISTINCT sid) AS c",
        "session_count", 5, f"FROM sess WHERE {RANGE} AND final_level IS NOT NULL GROUP BY 1, 2",
    ),
    "sess",
)
Q["b3_top_hours"] = sql(
    _dist(
        "SELECT local_hour, count(DISTINCT sid) AS c", "session_count", 5, f"FROM sess WHERE {RANGE} GROUP BY 1"
    )
    + " ORDER BY session_count DESC, local_hour LIMIT 6",
    "sess",
)
Q["b3_all_hours"] = Q["b3_top_hours"].removesuffix(" LIMIT 6")
_STREAK = """CASE WHEN n = 1 THEN '1 day' WHEN n <= 3 THEN '2-3 days' WHEN n <= 7 THEN '4-7 days'
  WHEN n <= 14 THEN '8-14 days' WHEN n <= 30 THEN '15-30 days' ELSE '30+ days' END"""
_STREAK_ORDER = """CASE WHEN n = 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 7 THEN 4 WHEN n <= 14 THEN 8
  WHEN n <= 30 THEN 15 ELSE 31 END"""


def _streaks(where: str) -> str:
    days = f"SELECT DISTINCT uid, evt_dt FROM sess WHERE uid IS NOT NULL AND {where}"
    ranked = f"SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY evt_dt) AS INTEGER) AS rn FROM ({days})"
    runs = f"SELECT uid, evt_dt - rn AS g, count(*) AS n FROM ({ranked}) GROUP BY 1, 2"
    return sql(
        _dist(
            f"SELECT {_STREAK} AS streak_bucket, {big(f'{_STREAK_ORDER}:bucket_order')}, count(*) AS c", "user_count",
            4, f"FROM (SELECT uid, max(n) AS n FROM ({runs}) GROUP BY uid) GROUP BY 1, 2",
        ),
        "sess",
    )


Q["b4_streaks"] = _streaks("TRUE")
Q["b4_streaks_from_bits"] = Q["b4_streaks"]
Q["b4_streaks_from_bits_range"] = _streaks("evt_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'")
Q["b4_streaks_range"] = _streaks("evt_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'")
Q["b5_user_day_buckets"] = sql(
    _dist(
        f"""SELECT CASE WHEN n <= 5 THEN CAST(n AS VARCHAR) WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20'
            ELSE '21+' END AS session_bucket, {big('CASE WHEN n <= 6 THEN n WHEN n <= 10 THEN 6 WHEN n <= 20 THEN 11 ELSE 21 END:bucket_order')},
            count(*) AS c""",
        "user_day_count", 4, f"FROM ({_UD.format(RANGE)}) GROUP BY 1, 2",
    ),
    "sess",
)
for _key, _id, _name in (("b6_user_totals", "uid", "user_count"), ("b7_device_totals", "device", "device_count")):
    Q[_key] = sql(
        _dist(
            f"SELECT {TOTAL} AS cumulative_bucket, {big(f'{TOTAL_ORDER}:bucket_order')}, count(*) AS c", _name, 4,
            f"""FROM (SELECT {_id}, count(DISTINCT sid) AS n FROM sess WHERE {RANGE} AND {_id} IS NOT NULL GROUP BY 1)
            GROUP BY 1, 2""",
        ),
        "sess",
    )
Q["b8_duration_buckets"] = sql(
    _dist(
        f"""SELECT CASE WHEN sec >= 2700 THEN '45+ min' ELSE (sec // 300 * 5) || '-' || (sec // 300 * 5 + 5) || ' min' END
            AS duration_bucket, {big('least(sec // 300 + 1, 10):bucket_order')}, count(*) AS c""",
        "session_count", 4, f"FROM sess WHERE {RANGE} AND sec IS NOT NULL GROUP BY 1, 2",
    ),
    "sess",
)
Q["b9_mode_sessions"] = sql(
    f"SELECT mode_type, count(DISTINCT sid) AS cnt FROM modes WHERE {RANGE} GROUP BY 1", "modes"
)
for _suffix, _longest in (("", "TRUE"), ("_within_hour", "sec <= 3600")):
    Q[f"b10_mode_minutes{_suffix}"] = sql(
        f"SELECT mode_type, {rdiv('sum(sec)', '60', 2)} AS duration_min FROM modes WHERE {RANGE} AND {_longest} GROUP BY 1",
        "modes",
    )
    Q[f"b12_mode_minutes_per_session{_suffix}"] = sql(
        f"""SELECT mode_type, {rdiv('sum(sec)', '60 * count(DISTINCT sid)', 2)} AS avg_dur_per_sess_min
        FROM modes WHERE {RANGE} AND {_longest} GROUP BY 1""",
        "modes",
    )
Q["b11_mode_sessions_per_user"] = sql(
    f"""
    SELECT mode_type, {rdiv('sum(c)', 'sum(dau)', 4)} AS avg_sess_per_user
    FROM (SELECT evt_dt, mode_type, count(DISTINCT sid) AS c FROM modes WHERE {RANGE} GROUP BY 1, 2)
    JOIN (SELECT evt_dt, sum(dau) AS dau FROM daily WHERE {RANGE} GROUP BY 1) USING (evt_dt) GROUP BY 1""",
    "modes",
    "daily",
)
_HOURS = """SELECT day_type, local_hour, c AS session_count, {pct} AS pct FROM (
    SELECT CASE WHEN {flag} THEN 'weekday' ELSE 'weekend' END AS day_type, local_hour, count(DISTINCT sid) AS c
    FROM sess WHERE {where} GROUP BY 1, 2)"""
_pct_day = rdiv("c", "sum(c) OVER (PARTITION BY day_type)", 5)
Q["b13_hours_by_day_type"] = sql(_HOURS.format(pct=_pct_day, flag="is_weekday = 1", where=RANGE), "sess")
Q["b13_hours_by_event_weekday"] = sql(
    _HOURS.format(pct=_pct_day, flag="dayofweek(evt_dt) BETWEEN 1 AND 5", where=OWN), "sess"
)
Q["b14_mode_by_level"] = sql(
    _dist(
        f"SELECT final_mode, {LEVEL} AS level_bucket, count(DISTINCT sid) AS c", "session_count", 4,
        f"FROM sess WHERE {RANGE} AND final_mode IS NOT NULL AND final_level IS NOT NULL GROUP BY 1, 2",
        "final_mode", "pct_within_mode",
    ),
    "sess",
)
Q["b15_modes_used"] = sql(
    _dist(
        f"""SELECT CASE used_modes WHEN 1 THEN 'single' WHEN 2 THEN 'two' ELSE 'three or more' END AS mode_mix_type,
            {big('least(used_modes, 3):bucket_order')}, count(DISTINCT sid) AS c""",
        "session_count", 4, f"FROM sess WHERE {RANGE} AND used_modes IS NOT NULL GROUP BY 1, 2",
    ),
    "sess",
)
_NAME = "CASE {} WHEN '0' THEN 'stimulation' WHEN '1' THEN 'expression' WHEN '2' THEN 'mixed' ELSE 'custom' END"


def _transitions(where: str, limit: str) -> str:
    return sql(
        f"""
    SELECT from_mode, to_mode, from_mode || ' → ' || to_mode AS adjust_path, c AS adjust_count,
      {rdiv('c', 'sum(c) OVER ()', 4)} AS pct
    FROM (SELECT {_NAME.format('adj_from')} AS from_mode, {_NAME.format('adj_to')} AS to_mode, count(*) AS c
          FROM dwd WHERE d BETWEEN DATE '{START}' AND DATE '{END}' AND type = 'pump_mode' {where} GROUP BY 1, 2)
    ORDER BY adjust_count DESC, adjust_path {limit}""",
        "dwd",
    )


Q["b16_mode_transitions"] = _transitions("", "LIMIT 6")
Q["b16_mode_transitions_changed"] = _transitions("AND adj_from <> adj_to", "LIMIT 100")
Q["b17_level_directions"] = sql(
    _dist(
        "SELECT direction, CAST(sum(n) AS BIGINT) AS c", "adjust_count", 4,
        f"""FROM (SELECT 'up' AS direction, level_up AS n FROM sess WHERE {RANGE}
            UNION ALL SELECT 'down', level_down FROM sess WHERE {RANGE}
            UNION ALL SELECT 'same', level_adj - level_up - level_down FROM sess WHERE {RANGE}) GROUP BY 1""",
    ),
    "sess",
)
Q["b18_adjusts_per_session"] = sql(
    _dist(
        f"""SELECT kind, {big('least(n, 10):bucket_order')}, CASE WHEN n >= 10 THEN '10+' ELSE CAST(n AS VARCHAR) END
            AS adj_bucket, count(*) AS c""",
        "session_count", 4,
        f"""FROM (SELECT 'level' AS kind, level_adj AS n FROM sess WHERE {RANGE}
            UNION ALL SELECT 'mode', mode_adj FROM sess WHERE {RANGE}) GROUP BY 1, 2, 3""",
        "kind",
    ),
    "sess",
)
for _key, _names in (
    ("b19_event_sources", "'pump_start', 'pump_end', 'pump_manual_adjust_evt'"),
    ("b19_event_sources_sessions", "'pump_session_start', 'pump_session_end', 'pump_manual_adjust_evt'"),
):
    Q[_key] = sql(
        _dist(
            "SELECT CASE source WHEN 'remote_app' THEN 'app' WHEN 'local_device' THEN 'hardware' ELSE source END"
            " AS source_type, count(*) AS c",
            "event_count", 4,
            f"""FROM dwd WHERE d BETWEEN DATE '{START}' AND DATE '{END}' AND source IS NOT NULL
                AND name IN ({_names}) GROUP BY 1""",
        ),
        "dwd",
    )
for _suffix, _own in (("", "TRUE"), ("_model", f"model = '{MODEL}'")):
    _days = ", ".join(
        f"{rdiv(f'count(DISTINCT CASE WHEN a.evt_dt = f.first_dt + {n} THEN f.uid END)', 'count(DISTINCT f.uid)', 4)} AS d{n}_pct"
        for n in (1, 3, 7, 14)
    )
    Q[f"b20_weekly_cohorts{_suffix}"] = sql(
        f"""
    WITH s AS (SELECT * FROM sess WHERE uid IS NOT NULL AND {_own}),
      f AS (SELECT uid, min(evt_dt) AS first_dt FROM s GROUP BY uid),
      a AS (SELECT DISTINCT uid, evt_dt FROM s)
    SELECT CAST(date_trunc('week', f.first_dt) AS DATE) AS install_week, count(DISTINCT f.uid) AS new_users, {_days}
    FROM f LEFT JOIN a ON f.uid = a.uid WHERE f.first_dt BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1""",
        "sess",
    )
    Q[f"b20_weekly_cohorts_from_bits{_suffix}"] = Q[f"b20_weekly_cohorts{_suffix}"]

# ---- user flags -----------------------------------------------------------------------------------

AS_OF = f"DATE '{AS_OF_USERS}'"
_IN = (
    f"country IN ({', '.join(repr(c) for c in USER_QUERY_COUNTRIES)})"
    f" AND source IN ({', '.join(repr(c) for c in USER_QUERY_SOURCES)})"
)
_AGO = f"event_date >= strftime({AS_OF} - {{}}, '%Y-%m-%d')"
_DATED = "event_date IS NOT NULL AND event_date <> ''"
Q["u1_filtered_records"] = sql(
    f"""SELECT uid, country AS country_ad_ch, source AS data_source, active_status, event_date FROM uflag
    WHERE {_IN} AND active_status = '1' AND event_date >= '{FROM_DAY}' AND event_date <= '{TO_DAY}'""",
    "uflag",
)
Q["u1_filtered_last_days"] = sql(
    f"SELECT uid, country AS country_ad_ch, event_date FROM uflag WHERE {_AGO.format(90)}", "uflag"
)
Q["u2_filter_options"] = sql(
    "SELECT country AS country_ad_ch, count(DISTINCT uid) AS cnt FROM uflag WHERE country <> '' GROUP BY 1", "uflag"
)


def _overview(where: str, active: str) -> str:
    return sql(
        f"""
    WITH t AS (SELECT count(DISTINCT uid) AS total_users, CAST(coalesce(sum(CASE WHEN deleted = '1' THEN 1 ELSE 0 END), 0) AS BIGINT)
        AS deleted_users, count(DISTINCT country) AS country_count, max(update_date) AS latest_update_date,
        max(event_date) AS latest_event_date FROM uflag WHERE {where}),
      a AS (SELECT count(DISTINCT uid) AS n FROM uflag WHERE {active} AND {_DATED})
    SELECT greatest(t.total_users, 1) AS total_users, a.n AS active_users,
      greatest(greatest(t.total_users, 1) - a.n, 0) AS inactive_users, deleted_users,
      {even('a.n / CAST(greatest(t.total_users, 1) AS DOUBLE) * 100', 2)} AS active_rate, country_count,
      latest_update_date, latest_event_date FROM t, a""",
        "uflag",
    )


_SPAN = f"{_IN} AND event_date >= '{FROM_DAY}' AND event_date <= '{TO_DAY}'"
Q["u3_overview"] = _overview("TRUE", _AGO.format(30))
Q["u3_overview_filtered"] = _overview(_SPAN, _SPAN)
Q["u3_overview_nobody"] = _overview("country = 'nowhere'", f"country = 'nowhere' AND {_AGO.format(30)}")
Q["u4_active_users"] = sql(
    f"SELECT count(DISTINCT uid) AS active_users FROM uflag WHERE {_AGO.format(30)} AND {_DATED}", "uflag"
)
Q["u5_active_rate"] = sql(
    f"""
    SELECT active_users, greatest(total_users - active_users, 0) AS inactive_users,
      {even('active_users / CAST(total_users AS DOUBLE) * 100', 2)} AS active_rate
    FROM (SELECT count(DISTINCT uid) AS total_users,
            count(DISTINCT CASE WHEN {_AGO.format(30)} THEN uid END) AS active_users FROM uflag)""",
    "uflag",
)
Q["u6_users_by_source"] = sql(
    f"SELECT source AS data_source, count(DISTINCT uid) AS user_count FROM uflag WHERE {_AGO.format(90)} GROUP BY 1",
    "uflag",
)
Q["u7_top_countries"] = sql(
    """SELECT country AS country_ad_ch, count(DISTINCT uid) AS user_count FROM uflag WHERE country <> '' GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""",
    "uflag",
)
Q["u8_daily_users"] = sql(
    f"""SELECT event_date, count(DISTINCT uid) AS daily_users FROM uflag WHERE {_AGO.format(900)} AND {_DATED}
    GROUP BY 1""",
    "uflag",
)
_FLAGS = ["act", "device_vis", "stat_vis", "dynamic_vis", "account_vis", "member_vis", "moment_act"]
_flag_sums = ", ".join(
    f"count(CASE WHEN ok % {p} = 0 THEN 1 END) AS {n}_users" for n, p in zip(_FLAGS, (2, 3, 5, 7, 11, 13, 17))
)
Q["u9_flag_counts"] = sql(f"SELECT {_flag_sums}, count(*) AS total_records FROM uflag WHERE {_IN}", "uflag")
Q["u9_flag_counts_long"] = sql(
    f"""SELECT flag, records FROM (UNPIVOT (SELECT {_flag_sums}, count(*) AS total_records FROM uflag)
    ON {', '.join(f'{n}_users' for n in _FLAGS)}, total_records INTO NAME flag VALUE records)""",
    "uflag",
)

# ---- firmware -------------------------------------------------------------------------------------

DEV_DAY = f"DATE '{AS_OF_DEVICES}'"
REGION = "CASE source WHEN 'EC' THEN 'US-East' WHEN 'EU' THEN 'Europe' WHEN 'AP' THEN 'Asia-Pacific' ELSE 'other' END"
STATUS = "CASE status WHEN 2 THEN 'bound' ELSE 'unbound' END"


def _ftrend(as_of: str, where: str = "TRUE") -> str:
    return f"""SELECT CAST(ts AS DATE) AS create_date, version, count(*) AS devices FROM dev
      WHERE version IS NOT NULL AND ts >= CAST({as_of} - 30 AS TIMESTAMP) AND {where} GROUP BY 1, 2"""


Q["f1_version_trend"] = sql(_ftrend(DEV_DAY), "dev")
Q["f1_version_trend_filtered"] = sql(_ftrend(DEV_DAY, "model = 'click' AND source = 'EU' AND status = 2"), "dev")
Q["f2_region_status_labels"] = sql(
    f"SELECT {REGION} AS region, {STATUS} AS status, count(*) AS devices FROM dev GROUP BY 1, 2", "dev"
)
Q["f3_filter_options"] = sql(
    f"""
    SELECT 'model' AS option, row_number() OVER (ORDER BY value) AS rank, value FROM (SELECT DISTINCT model AS value FROM dev)
    UNION ALL SELECT 'region', row_number() OVER (ORDER BY value), value FROM (SELECT DISTINCT {REGION} AS value FROM dev)
    UNION ALL SELECT 'status', 1, 'bound' UNION ALL SELECT 'status', 2, 'unbound'
    UNION ALL SELECT 'version', row_number() OVER (ORDER BY CAST(value AS DOUBLE)), value
      FROM (SELECT DISTINCT version AS value FROM dev WHERE version IS NOT NULL)""",
    "dev",
)
def _versions(where: str) -> str:
    return sql(
        f"""SELECT version, c AS devices, {rdiv('c * 100', 'sum(c) OVER ()', 1)} AS pct FROM (
        SELECT version, count(*) AS c FROM dev WHERE version IS NOT NULL AND {where} GROUP BY 1)""",
        "dev",
    )


Q["f4_versions_bound"] = _versions("status = 2")
Q["f4_versions_unbound_filtered"] = _versions("status = 1 AND source = 'AP' AND model = 'view'")


def _matrix(trend: str) -> str:
    return sql(
        f"""
    WITH t AS ({trend}) SELECT d.create_date, v.version, coalesce(t.devices, 0) AS devices
    FROM (SELECT DISTINCT create_date FROM t) d CROSS JOIN (SELECT DISTINCT version FROM t) v
    LEFT JOIN t ON t.create_date = d.create_date AND t.version = v.version""",
        "dev",
    )


_rare = "model = 'purchase' AND source = 'EU' AND status = 1"
Q["f5_version_matrix"] = _matrix(_ftrend(DEV_DAY, _rare))
# Seen from half a year later nothing is recent, so all rows stay.
Q["f5_version_matrix_fallback"] = _matrix(_ftrend(DEV_DAY, _rare))
_cells = ", ".join(f"coalesce(sum(devices) FILTER (version = '{v}'), 0)::BIGINT AS \"{v}\"" for v in FIRMWARE_VERSIONS)
Q["f5_version_matrix_wide"] = sql(f"SELECT create_date, {_cells} FROM ({_ftrend(DEV_DAY, _rare)}) GROUP BY 1", "dev")
_DETAIL = f"""SELECT name AS device_name, right(device_id, 8) AS id_suffix, sn, model, type_id, mac, version,
    {STATUS} AS status, CAST(ts AS DATE) AS create_time, CAST(ts AS DATE) AS update_time, CAST(ts AS DATE) AS last_login,
    {REGION} AS region FROM dev WHERE {{}}"""
Q["f6_device_details"] = sql(_DETAIL.format("TRUE"), "dev")
Q["f6_device_details_filtered"] = sql(_DETAIL.format("source = 'EC' AND status = 1 AND model = 'error'"), "dev")
Q["f7_version_domain"] = sql("SELECT DISTINCT version FROM dev WHERE version IS NOT NULL", "dev")

# ---- shaping --------------------------------------------------------------------------------------

Q["j1_clip"] = sql(
    f"""SELECT evt_dt AS dt, {big('sum(sessions):session_count')} FROM daily
    WHERE {RANGE} AND evt_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1""",
    "daily",
)
Q["j1_clip_base_date"] = sql(
    """SELECT base_dt AS base_date, d1_user_e5 / 1e5 AS d1_user_retention_pct, d7_user_e5 / 1e5 AS d7_user_retention_pct
    FROM ret WHERE base_dt BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""",
    "ret",
)
Q["j2_shares"] = sql(
    f"""SELECT mode_type, cnt, {rdiv('cnt * 100', 'sum(cnt) OVER ()', 1)} AS pct
    FROM (SELECT mode_type, count(DISTINCT sid) AS cnt FROM modes WHERE {RANGE} GROUP BY 1)""",
    "modes",
)
Q["j3_percent_bars"] = sql(
    f"""
    SELECT local_hour, session_count, pct, pct * 100 AS bar_value,
      CAST(floor(pct * 100 / greatest(max(pct * 100) OVER (), 1.0) * 100 + 0.5) AS BIGINT) AS bar_width
    FROM (SELECT local_hour, c AS session_count, {rdiv('c', 'sum(c) OVER ()', 5)} AS pct
          FROM (SELECT local_hour, count(DISTINCT sid) AS c FROM sess WHERE {RANGE} GROUP BY 1))
    ORDER BY pct DESC, local_hour LIMIT 6""",
    "sess",
)
Q["j3_number_bars"] = sql(
    f"""
    SELECT mode_type, duration_min, duration_min AS bar_value,
      CAST(floor(duration_min / greatest(max(duration_min) OVER (), 0.001) * 100 + 0.5) AS BIGINT) AS bar_width
    FROM (SELECT mode_type, {rdiv('sum(sec)', '60', 2)} AS duration_min FROM modes WHERE {RANGE} GROUP BY 1)""",
    "modes",
)

# ---- sections: every row of every frame, as text ---------------------------------------------------------------------

_PER_USER = "total_sessions, avg_sessions_per_user"
_FRAMES = {
    "overview": {
        "kpi01": f"SELECT total_users, total_devices, {_PER_USER} FROM @k1_overview_totals@",
        "kpi01_extra": "SELECT total_duration_hours, avg_duration_min, devices_per_user, valid_session_rate_pct,"
        " d1_user_ret AS d1_retention_pct FROM @k1_overview_totals@ CROSS JOIN @k3_mean_d1_retention@",
        "kpi_yesterday": "k5_yesterday_card", "active_trend": "t1_active_trend",
        "session_trend": "t2_session_trend", "final_modes": "b1_final_modes", "suction_levels": "b2_suction_levels",
        "top_hours": "b3_top_hours",
    },
    "retention": {
        "summary": "k6_retention_summary", "user_retention": "t6_user_retention_trend", "device_retention": "t7_device_retention_trend",
        "newcomers": "t5_newcomer_trend", "streaks": "b4_streaks", "weekly_cohorts": "b20_weekly_cohorts",
    },
    "sessions": {
        "kpi01": f"SELECT {_PER_USER} FROM @k1_overview_totals@",
        "summary": "k7_sessions_summary", "kpi_yesterday": "k8_sessions_yesterday", "session_trend": "t2_session_trend",
        "sessions_per_user": "t4_sessions_per_user_trend", "user_day_buckets": "b5_user_day_buckets",
        "user_day_bucket_trend": "t14_user_day_bucket_trend", "user_totals": "b6_user_totals",
        "device_totals": "b7_device_totals", "mode_sessions": "b9_mode_sessions",
        "mode_session_trend": "t15_mode_session_trend", "mode_sessions_per_user": "b11_mode_sessions_per_user",
    },
    "duration": {
        "summary": "k9_duration_summary", "kpi_yesterday": "k10_duration_yesterday", "hours_trend": "t8_hours_trend",
        "minutes_per_user": "t9_minutes_per_user_trend", "duration_buckets": "b8_duration_buckets",
        "mean_duration": "t10_mean_duration_trend", "cumulative_hours": "t11_cumulative_hours_trend",
        "mode_minutes": "b10_mode_minutes", "mode_minutes_trend": "t16_mode_minutes_trend",
        "mode_minutes_per_session": "b12_mode_minutes_per_session",
    },
    "habits": {
        "hours_by_day_type": "b13_hours_by_day_type", "mode_by_level": "b14_mode_by_level",
        "modes_used": "b15_modes_used", "mode_transitions": "b16_mode_transitions",
        "level_directions": "b17_level_directions",
        "level_adjusts": "SELECT * EXCLUDE (kind) FROM @b18_adjusts_per_session@ WHERE kind = 'level'",
        "mode_adjusts": "SELECT * EXCLUDE (kind) FROM @b18_adjusts_per_session@ WHERE kind = 'mode'",
        "adjust_summary": "k11_adjust_summary", "pause_stats": "k12_pause_stats", "event_sources": "b19_event_sources",
    },
    "funnel": {
        "kpi02": "k2_funnel_totals", "funnel": "k13_funnel_rates", "funnel_trend": "t12_funnel_trend", "funnel_rate_trend": "t13_funnel_rate_trend",
    },
    "firmware": {
        "bound": "f4_versions_bound", "unbound": _versions("status = 1"),
        "trend": "f1_version_trend", "detail": "f6_device_details",
    },
}


# Numbers get six decimals in both engines; whatever else a value is, it stays as it is written.
_VALUE = "CASE WHEN regexp_full_match(value, '-?[0-9]+([.][0-9]+)?(E-?[0-9]+)?') THEN printf('%.6f', CAST(value AS DOUBLE)) ELSE coalesce(value, 'null') END"


def _section(frames: dict) -> str:
    rows = []
    for name, text in frames.items():
        text = re.sub("@([a-z0-9_]+)@", lambda m: f"({Q[m[1]]})", Q.get(text, text))
        rows.append(
            f"""SELECT '{name}' AS frame, string_agg(field || '=' || {_VALUE}, ', ' ORDER BY field) AS row
            FROM (SELECT rid, CAST(COLUMNS(* EXCLUDE (rid)) AS VARCHAR) FROM (SELECT row_number() OVER () AS rid, * FROM ({text})))
            UNPIVOT INCLUDE NULLS (value FOR field IN (COLUMNS(* EXCLUDE (rid))))
            GROUP BY rid"""
        )
    return " UNION ALL ".join(rows)


for _name, _frames in _FRAMES.items():
    Q[f"w4_section_{_name}"] = _section(_frames)

# Reports from the roll-up mart: the same results as from sessions.
for _name in [
    "k11_adjust_summary", "k12_pause_stats", "t15_mode_session_trend", "t16_mode_minutes_trend", "b1_final_modes", "b2_suction_levels",
    "b3_top_hours", "b8_duration_buckets", "b9_mode_sessions", "b10_mode_minutes", "b11_mode_sessions_per_user",
    "b12_mode_minutes_per_session", "b13_hours_by_day_type", "b13_hours_by_event_weekday", "b14_mode_by_level", "b15_modes_used",
    "b17_level_directions", "b18_adjusts_per_session", "w4_section_overview", "w4_section_sessions", "w4_section_duration", "w4_section_habits",
]:
    Q[f"{_name}_from_rollups"] = Q[_name]
Q["b1_final_modes_from_rollups_model"] = Q["b1_final_modes_model"]
