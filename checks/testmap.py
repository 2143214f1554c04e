"""Usage tables derived from the bundled test tables (formulas: FIXTURES.md section 2).

Everything here is a narrow projection of ``events`` (or of ``orders`` joined to its dimensions),
so the derived tables grow with the given ones.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.session import bound_shuffles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per test event = one use session. A user's events before a first day of their own go to another user."""
    e = table(spark, sf_dir, "events").selectExpr(
        "*", "cast(get_json_object(props, '$.k') as int) as k", "cast(ts as date) as d"
    )
    return e.selectExpr(
        "event_id",
        "k",
        "d",
        "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('second', ts)) as sec",
        "if(user_id % 17 = 0, null, concat(if(datediff(d, date'2024-01-01') < user_id % 25, 'e', 'u'), user_id)) as uid",
        "concat('D', user_id % 3) as model",
        "if(event_id % 2 = 0, 'iOS', 'Android') as os",
        "hour(ts) as hour",
        "if(dayofweek(d) between 2 and 6, 1, 0) as weekday",
        "if(k % 10 = 0, null, cast(floor(value * 20) as int)) as dur",
        "1 + k % 3 as n_modes",
    )


# Sessions of a task that makes raw rows: a dozen wide rows each, which are sorted in memory when they are written.
SESSIONS_A_TASK = 20_000
# Those of a task that makes a part of the log to be stored: a later task reads a few such files at a time.
SESSIONS_A_FILE = 5_000

# The report day of a session's rows: those of a third of the sessions come up to eight days late.
REPORT_DAY = "date_add(d, cast(if(event_id % 3 = 0, k % 9, 0) as int))"

MODE_LABEL = "element_at(array('expression', 'massage', 'stimulation'), cast(({}) % 3 as int) + 1)"
CODE_LABEL = "element_at(array('stimulation', 'expression', 'mixed', 'custom'), cast(({}) % 4 as int) + 1)"
WALL_CLOCK = "timestampadd(SECOND, sec, timestamp_ntz'1970-01-01 00:00:00')"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = "concat({}, '→', {})".format(CODE_LABEL.format("event_id + j"), CODE_LABEL.format("event_id + 3 * j"))
    done = "if(dur is null, null, {})"
    return base(spark, sf_dir).selectExpr(
        "d as evt_dt",
        "cast(event_id as string) as useSessionId",
        "uid",
        "concat(uid, '-00', event_id % 2) as pump_device_id",
        "model as deviceCode",
        "os",
        f"{WALL_CLOCK} as start_time",
        f"{done.format(WALL_CLOCK)} as end_time",
        "hour as local_hour",
        "weekday as is_weekday",
        "dur as total_duration_sec",
        "cast(round(dur / 60, 2) as decimal(8,2)) as total_duration_min",
        "if(dur is null, 0, 1) as is_complete",
        "if(dur > 600, 1, 0) as is_valid",
        f"{done.format(MODE_LABEL.format('event_id'))} as finalModeType",
        f"{done.format('cast(k % 14 as string)')} as finalSuctionLevel",
        "if(dur is null, null, if(k % 2 = 0, 'user', 'timeout')) as endReason",
        f"{done.format('n_modes')} as usedModeCount",
        "cast(k % 4 as bigint) as mode_adj_cnt",
        f"if(k % 4 = 0, null, array_join(transform(sequence(0, k % 4 - 1), j -> {step}), ',')) as mode_adj_path",
        "cast(k % 13 as bigint) as level_adj_cnt",
        "cast((k % 13) div 2 as bigint) as level_up_cnt",
        "cast((k % 13) div 3 as bigint) as level_down_cnt",
        "cast(k % 5 as bigint) as pause_cnt",
        "cast(if(k % 2 = 0, k % 4 + k % 13, 0) as bigint) as app_op_cnt",
        "cast(if(k % 2 = 0, 0, k % 4 + k % 13) as bigint) as manual_op_cnt",
    )


def _mode_rows(alias: str = "m") -> str:
    """Array of (modeType, sec) of a complete session; the durations add up to ``dur``."""
    label = MODE_LABEL.format("event_id + i")
    return (
        f"transform(sequence(0, n_modes - 1), i -> named_struct("
        f"'durationSec', cast(dur div n_modes + if(i = n_modes - 1, dur % n_modes, 0) as int),"
        f"'modeType', {label})) as {alias}"
    )


def session_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).where("dur is not null").selectExpr("*", _mode_rows())
    return rows.selectExpr("*", "explode(m) as x").selectExpr(
        "d as evt_dt",
        "cast(event_id as string) as useSessionId",
        "uid",
        "concat(uid, '-00', event_id % 2) as pump_device_id",
        "model as deviceCode",
        "x.modeType as modeType",
        "x.durationSec as duration_sec",
        "cast(round(x.durationSec / 60, 2) as decimal(8,2)) as duration_min",
    )


# The events of one session as (first offset n in ms, how many, fields by SQL).
_EVENTS = [
    (0, "1", {"eventName": "'pump_startup_evt'"}),
    (1, "if(k % 4 = 0, 1, 0)", {"eventName": "'pump_startup_evt'"}),
    (2, "1", {"eventName": "'pump_session_start'", "evtSource": "start_source"}),
    (
        3,
        "k % 4",
        {
            "eventName": "'pump_manual_adjust_evt'",
            "evtType": "'pump_mode'",
            "evtSource": "op_source",
            "adjustFrom": "cast((event_id + j) % 4 as string)",
            "adjustTo": "cast((event_id + 3 * j) % 4 as string)",
        },
    ),
    (
        10,
        "k % 13",
        {
            "eventName": "'pump_manual_adjust_evt'",
            "evtType": "'suction_level'",
            "evtSource": "op_source",
            "adjustFrom": "cast(1 + j as string)",
            "adjustTo": "cast(1 + j + case when j < (k % 13) div 2 then 1"
            " when j < (k % 13) div 2 + (k % 13) div 3 then -1 else 0 end as string)",
        },
    ),
    (30, "k % 5", {"eventName": "'pump_user_evt'", "evtType": "'pause'"}),
    (
        90,
        "if(dur is null, 0, 1)",
        {
            "eventName": "'pump_session_end'",
            "evtSource": "start_source",
            "finalModeType": MODE_LABEL.format("event_id"),
            "finalSuctionLevel": "cast(k % 14 as string)",
            "modeDuration": f"to_json({_mode_rows('').rsplit(' as ', 1)[0]})",
            "usedModeCount": "n_modes",
            "endReason": "if(k % 2 = 0, 'user', 'timeout')",
        },
    ),
]


def _member(name: str, value: str, quoted: bool = True) -> str:
    """A member of a JSON object by SQL, null for a null value. The test values hold nothing that JSON escapes."""
    mark = '"' if quoted else ""
    return f"concat('\"{name}\":{mark}', {value}, '{mark}')"


def raw_log(spark: SparkSession, sf_dir: str, days: list[date] | None = None) -> DataFrame:
    """The raw JSON log: the events of every session plus some rows of other kinds; of the given report days only, if any are given."""
    names = [
        "evtType", "evtSource", "adjustFrom", "adjustTo", "finalModeType",
        "finalSuctionLevel", "modeDuration", "usedModeCount", "endReason",
    ]
    # A session is opened into the offsets of its events, plain numbers; the fields of an event are told from its offset, where the row is made.
    offsets, event_names, rest, firsts = [], [], [], []
    for first, count, fields in reversed(_EVENTS):
        offsets.insert(0, f"if({count} > 0, sequence({first}, {first} - 1 + {count}), cast(array() as array<int>))")
        event_names.append(f"when n >= {first} then {fields['eventName']}")
        firsts.append(f"when n >= {first} then {first}")
        if len(fields) > 1:
            members = [_member(n, fields[n], n not in ("modeDuration", "usedModeCount")) for n in names if n in fields]
            rest.append(f"when n >= {first} then concat_ws(',', {', '.join(members)})")
        else:
            rest.append(f"when n >= {first} then null")
    # A session becomes a dozen JSON rows: spread them before, a small file may be a single partition. Dealt by day, the rows made
    # in a task belong to few days, of events and of reports, and are written where they are, in few files, without a shuffle of the wide rows.
    # A stated number of partitions is one that Spark does not merge by their size before the JSON is made.
    opened, pages = base(spark, sf_dir), base(spark, sf_dir).where("event_id % 7 = 0")
    if days:
        opened, pages = opened.where(F.expr(REPORT_DAY).isin(days)), pages.where(F.col("d").isin(days))
    # As many tasks as the sessions of the days need.
    known, size = (opened, SESSIONS_A_FILE) if days else (table(spark, sf_dir, "events"), SESSIONS_A_TASK)
    found = known.count()
    bound_shuffles(spark, found)
    tasks = max(spark.sparkContext.defaultParallelism, -(-found // size))
    rows = opened.repartitionByRange(tasks, "d", F.expr(REPORT_DAY), "event_id").selectExpr(
        "*",
        "if(k % 2 = 0, 'remote_app', 'manual') as op_source",
        "if(event_id % 2 = 0, 'remote_app', 'local_device') as start_source",
    )
    # modeDuration is made in the row, by a lambda: with it made before, Java leaves the code of the whole row, a method of over 8000 bytes, uncompiled.
    rows = rows.selectExpr("*", f"explode(concat({', '.join(offsets)})) as n").selectExpr("*", f"n - case {' '.join(firsts)} end as j")
    extra = [
        _member("eventName", f"case {' '.join(event_names)} end"),
        _member("evtTimestamp", "sec * 1000 + n", quoted=False),
        _member("useSessionId", "event_id"),
        _member("deviceCode", "model"),
        _member("payload", "concat('00000000-00', event_id % 2)"),
        f"case {' '.join(rest)} end",
    ]
    rows = rows.selectExpr(
        "*",
        f"{REPORT_DAY} as dt",
        f"concat('{{', concat_ws(',', {', '.join(extra)}), '}}') as extra",
    )
    outer = [
        _member("eventSessionId", "concat('s', event_id)"), _member("deviceId", "'phone'"), _member("os", "os"),
        _member("timezoneOffset", "'GMT+0'"),
    ]
    return rows.selectExpr(
        "event_id * 100 + n as id",
        "dt",
        "'demo' as app",
        "'a1' as appid",
        "unix_date(dt) * 86400000L + n as writetime",
        "cast(null as string) as url",
        "cast(null as string) as traceid",
        "uid",
        "'custom' as eventtype",
        "'Pump Log' as eventname",
        # extraData is an object in one half of the log and a string in the other
        "concat('{\"extraData\":', if(event_id % 2 = 0, extra, concat('\"', replace(extra, '\"', '\\\\\"'), '\"')),"
        f" ',', concat_ws(',', {', '.join(outer)}), '}}') as content",
        "unix_date(dt) * 86400000L + n + 1 as createtime",
        "'EC' as data_source",
    ).unionByName(
        pages.selectExpr(
            "event_id * 100 + 99 as id", "d as dt", "'demo' as app", "'a1' as appid",
            "sec * 1000 as writetime", "cast(null as string) as url", "cast(null as string) as traceid",
            "uid", "'custom' as eventtype", "'Page Log' as eventname", "'{}' as content",
            "sec * 1000 as createtime", "'EC' as data_source",
        )
    )


def user_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    rows = o.join(c, o.o_custkey == c.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    names = ["act", "device_vis", "stat_vis", "dynamic_vis", "account_vis", "member_vis", "moment_act"]
    primes = [2, 3, 5, 7, 11, 13, 17]
    return rows.selectExpr(
        "cast(o_custkey as string) as uid",
        "n_name as country_ad_ch",
        "case r_name when 'AMERICA' then 'EC' when 'EUROPE' then 'EU' else 'AP' end as data_source",
        "if(o_orderkey % 2 = 0, '1', '0') as active_status",
        "if(o_orderkey % 23 = 0, '1', '0') as deleted",
        "if(o_orderkey % 19 = 0, '', date_format(o_orderdate, 'yyyy-MM-dd')) as event_date",
        "date_format(o_orderdate, 'yyyy-MM-dd') as update_date",
        *[f"if(o_orderkey % {p} = 0, '1', '0') as {name}_flag" for name, p in zip(names, primes)],
    ).select(*schemas.column_names(schemas.USER_FLAGS))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k")
    return e.selectExpr(
        "cast(event_id as string) as device_id",
        "concat('SN', event_id) as sn",
        "event_type as model",
        "concat('T', event_id % 4) as type_id",
        "concat('mac-', event_id) as mac",
        "if(k = 99, '{\"romVersion\": null}', concat('{\"romVersion\": ', k % 7, '}')) as device_info",
        "cast(1 + event_id % 2 as int) as status",
        "ts as create_time",
        "ts as update_time",
        "ts as last_login",
        "case user_id % 4 when 0 then 'EC' when 1 then 'EU' when 2 then 'AP' else 'XX' end as data_source",
        "concat('device ', event_id) as device_name",
    )
