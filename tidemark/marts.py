"""The set of tables the reports read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.sources.tables import read_table


@dataclass
class Marts:
    """Lazy frames, one per table; ``None`` for a table the caller does not need.

    ``sessions`` holds one row per (evt_dt, useSessionId) and ``session_modes`` one per
    (evt_dt, useSessionId, modeType): the keys the writers enforce. Reports that group by day
    rely on it and count rows where they would otherwise need a distinct count.
    """

    sessions: DataFrame | None = None
    session_modes: DataFrame | None = None
    daily: DataFrame | None = None
    retention: DataFrame | None = None
    events: DataFrame | None = None
    user_flags: DataFrame | None = None
    devices: DataFrame | None = None
    activity_bits: DataFrame | None = None
    first_seen: DataFrame | None = None
    increments: DataFrame | None = None
    rollups: DataFrame | None = None

    @classmethod
    def read(cls, spark, root: str) -> "Marts":
        """All marts of a warehouse folder; a table that nobody has written there yet stays ``None``.

        ``plans.chain`` writes the five usage marts and the four of its state, ``user_flags`` and ``devices`` come from other jobs.
        """
        found = {}
        for name in ["sessions", "session_modes", "daily", "retention", "events", "user_flags", "devices", "activity_bits", "first_seen", "increments", "rollups"]:
            try:
                found[name] = read_table(spark, root, name)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return cls(**found)


def in_range(df: DataFrame, start: str, end: str, device_code: str | None = None, day: str = "evt_dt") -> DataFrame:
    """Rows of the days start..end, of one device model if given."""
    df = df.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if device_code:
        df = df.where(F.col("deviceCode") == device_code)
    return df


def as_date(value: str) -> Column:
    return F.lit(value).cast("date")
