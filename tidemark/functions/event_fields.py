"""Columns taken out of one raw log row: JSON fields, times, durations and the device key.

All times come from epoch arithmetic, so the result does not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the log format.
ZONE_PATTERN = r"GMT([+-]\d+)"
DURATION_PATTERN = r'"durationSec"\s*:\s*(\d+)'
MODE_PATTERN = r'"modeType"\s*:\s*"([^"]+)"'


def whole_seconds(millis: Column) -> Column:
    return F.floor(millis / 1000).cast("bigint")


def moment(seconds: Column) -> Column:
    """Epoch seconds as a wall-clock timestamp."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def calendar_day(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))


def local_seconds(seconds: Column, zone: Column) -> Column:
    """Epoch seconds shifted by the whole hours of 'GMT+8'; NULL for any other zone text."""
    hours = F.regexp_extract(zone, ZONE_PATTERN, 1).try_cast("int")
    return seconds + hours * 3600


def hour_of(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def is_weekday(seconds: Column) -> Column:
    """1 from Monday to Friday, else 0; an unknown local time counts as 0."""
    return F.when(F.dayofweek(calendar_day(seconds)).between(2, 6), 1).otherwise(0)


def adjust_direction(event_type: Column, before: Column, after: Column) -> Column:
    """up / down / same of a level change; values that are not numbers count as 'same'."""
    change = after.try_cast("int") - before.try_cast("int")
    return F.when(
        event_type == "suction_level",
        F.when(change > 0, "up").when(change < 0, "down").otherwise("same"),
    )


def durations(mode_duration: Column) -> Column:
    """All durationSec values, in order; also found in text that is not valid JSON."""
    found = F.regexp_extract_all(mode_duration, F.lit(DURATION_PATTERN), F.lit(1))
    return F.transform(found, lambda text: text.try_cast("int"))


def mode_types(mode_duration: Column) -> Column:
    return F.regexp_extract_all(mode_duration, F.lit(MODE_PATTERN), F.lit(1))


def total_duration(mode_duration: Column) -> Column:
    """Sum of the durations; NULL when there is none."""
    known = F.filter(durations(mode_duration), lambda sec: sec.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("bigint"), lambda acc, sec: acc + sec)
    return F.when(F.size(known) > 0, total).try_cast("int")


def device_key(uid: Column, payload: Column) -> Column:
    """User id plus characters 9-12 of the payload; NULL when either part is missing."""
    return F.when(F.length(payload) >= 12, F.concat(uid, F.substring(payload, 9, 4)))
