"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt
import json

from tidemark import schemas


def frame(spark, table: str, rows: list[dict]):
    """Rows given as dicts; missing columns are NULL."""
    ddl = schemas.TABLES[table][0]
    names, types = schemas.column_names(ddl), schemas.column_types(ddl)
    values = [tuple(_value(row.get(n), t) for n, t in zip(names, types)) for row in rows]
    return spark.createDataFrame(values, ddl)


def _value(value, kind: str):
    if value is None:
        return None
    if kind == "DATE" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if kind == "TIMESTAMP_NTZ" and isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    if kind.startswith("DECIMAL"):
        from decimal import Decimal

        return Decimal(str(value))
    return value


def session(sid, day, uid="a", **extra) -> dict:
    row = {
        "evt_dt": day, "useSessionId": str(sid), "uid": uid, "pump_device_id": uid and f"{uid}-001",
        "deviceCode": "D1", "is_complete": 1, "is_valid": 1, "total_duration_sec": 700,
    }
    return {**row, **extra}


def millis(text: str) -> int:
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def log(id_, when, name, sid="s1", dt_=None, uid="a", as_text=False, zone="GMT+0", writetime=None, payload="00000000-001", **extra) -> dict:
    """One raw log row of an event at ``when``, reported on ``dt_`` (default: the same day)."""
    fields = {"eventName": name, "useSessionId": sid, "deviceCode": "D1", "payload": payload}
    if when is not None:
        fields["evtTimestamp"] = millis(when)
    fields.update(extra)
    fields = {k: v for k, v in fields.items() if v is not None}
    content = {"extraData": json.dumps(fields) if as_text else fields, "os": "iOS", "deviceId": "p", "eventSessionId": "e"}
    if zone is not None:
        content["timezoneOffset"] = zone
    day = dt_ or (when or "2024-01-01")[:10]
    return {
        "id": id_, "dt": day, "app": "x", "appid": "x", "writetime": writetime or millis(day), "uid": uid,
        "eventtype": "custom", "eventname": "Pump Log", "content": json.dumps(content),
        "createtime": millis(day), "data_source": "EC",
    }


def rows(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
