"""Raw app log -> exploded events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.functions import event_fields as ef
from tidemark.sources.writers import latest_by_key

# Fixed value: the log's name for device events.
EVENT_NAME = "Pump Log"

# Which JSON level each text column is read from.
CONTENT_FIELDS = ["eventSessionId", "deviceId", "os", "timezoneOffset"]
EXTRA_FIELDS = [
    "eventName",
    "useSessionId",
    "deviceCode",
    "evtType",
    "evtSource",
    "adjustFrom",
    "adjustTo",
    "finalModeType",
    "finalSuctionLevel",
    "modeDuration",
    "payload",
    "endReason",
]
EXTRA_NUMBERS = ["evtTimestamp", "usedModeCount"]


def explode_events(raw: DataFrame, start: str | None = None, end: str | None = None, name: str | None = None) -> DataFrame:
    """One row per device event of the report days start..end (all days when not given), or per event of one name.

    A narrow job: one scan, no shuffle. ``json_tuple`` parses each JSON text once for all its fields,
    and filters on them stay above it instead of being turned into further parses. It gives text
    for any value, so ``extraData`` may be a JSON object or a JSON string. Events of one name are told by it in the end; texts that
    cannot hold the name are not parsed.
    """
    rows = raw.where(F.col("eventname") == EVENT_NAME)
    if start:
        rows = rows.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("dt") <= F.lit(end).cast("date"))
    text = F.col("content")
    if name:
        text = F.when(_may_hold(text, name), text)  # no filter: one that is pushed down makes a computed text twice
    outer = ["extraData", *CONTENT_FIELDS]
    rows = rows.drop("eventname").select("*", F.json_tuple(text, *outer).alias(*outer))
    rows = rows.where(F.col("extraData").isNotNull())

    inner = F.json_tuple("extraData", *EXTRA_FIELDS, *EXTRA_NUMBERS)
    rows = rows.select("*", inner.alias(*EXTRA_FIELDS, *[f"{name}_text" for name in EXTRA_NUMBERS]))
    rows = rows.withColumns(
        {
            "evtTimestamp": F.col("evtTimestamp_text").try_cast("bigint"),
            "usedModeCount": F.col("usedModeCount_text").try_cast("int"),
        }
    )

    seconds = ef.whole_seconds(F.col("evtTimestamp"))
    rows = rows.withColumn("_local", ef.local_seconds(seconds, F.col("timezoneOffset")))
    rows = rows.withColumns(
        {
            "writetime_dt": ef.moment(ef.whole_seconds(F.col("writetime"))),
            "createtime_dt": ef.moment(ef.whole_seconds(F.col("createtime"))),
            "evtTimestamp_dt": ef.moment(seconds),
            "evt_dt": ef.calendar_day(seconds),
            "evtTimestamp_local": ef.moment(F.col("_local")),
            "local_hour": ef.hour_of(F.col("_local")),
            "is_weekday": ef.is_weekday(F.col("_local")),
            "adjust_direction": ef.adjust_direction(F.col("evtType"), F.col("adjustFrom"), F.col("adjustTo")),
            "total_duration_sec": ef.total_duration(F.col("modeDuration")),
            "pump_device_id": ef.device_key(F.col("uid"), F.col("payload")),
        }
    )
    if name:
        rows = rows.where(F.col("eventName") == name)
    return rows.select(*schemas.column_names(schemas.EVENTS))


def _may_hold(text: Column, name: str) -> Column:
    """Whether a JSON text may hold a value of letters, digits and ``_``: as it is, or with characters written as ``\\u`` and a number."""
    return text.contains(name) | text.contains("\\u")


def latest_events(events: DataFrame) -> DataFrame:
    """One row per (id, dt): the copy written last."""
    return latest_by_key(events, ["id", "dt"], [F.col("writetime"), F.col("createtime"), F.col("content")])


def latest_rows(raw: DataFrame) -> DataFrame:
    """The rows of the log from which ``explode_events`` makes the events that ``latest_events`` keeps."""
    rows = raw.where(F.col("eventname") == EVENT_NAME).select("*", F.json_tuple("content", "extraData").alias("_extra"))
    return latest_events(rows.where(F.col("_extra").isNotNull())).drop("_extra")
