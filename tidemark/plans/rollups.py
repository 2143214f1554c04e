"""Exact roll-ups of session counts by day: what distributions over any range of days need, without the session ids.

A session id may come again on other days, so distinct sessions of a range are not the sum of its days. Every count is
therefore split by the day on which the same session last had the same key: a session is new to start..end on its first day in
it, which is the one whose previous day lies before ``start`` or does not exist. Distinct sessions of any range are then a
plain sum over a few rows per day, and the mart does not grow with the number of sessions.

``prev_any`` is the previous day with any device model, ``prev_model`` the one with the same model.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas
from tidemark.functions import buckets as b
from tidemark.sources.writers import on_days

COUNTER_COLUMNS = ("level_adj_cnt", "mode_adj_cnt", "level_up_cnt", "level_down_cnt", "pause_cnt")


def event_weekday() -> Column:
    return F.when(F.dayofweek("evt_dt").between(2, 6), 1).otherwise(0)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _entry(kind: str, k1: Column | None = None, k2: Column | None = None, where: Column | None = None) -> Column:
    keys = [(_none("string") if k is None else k.cast("string")).alias(name) for name, k in (("k1", k1), ("k2", k2))]
    row = F.struct(F.lit(kind).alias("kind"), *keys)
    return row if where is None else F.when(where, row)


def _distinct_entries() -> Column:
    """The keys under which a session row counts as a session."""
    mode, level, hour, used = (F.col(c) for c in ("finalModeType", "finalSuctionLevel", "local_hour", "usedModeCount"))
    number = b.suction_level(level)
    label = b.bucket_label(number, b.SUCTION_LEVEL)
    return F.array_compact(
        F.array(
            _entry("session"),
            _entry("final_mode", mode, where=mode.isNotNull()),
            _entry("level", label, b.bucket_order(number, b.SUCTION_LEVEL), where=level.isNotNull()),
            _entry("hour", hour, where=hour.isNotNull()),
            _entry("day_type", F.col("is_weekday"), hour, where=hour.isNotNull()),
            _entry("event_day_type", event_weekday(), hour, where=hour.isNotNull() & F.year("evt_dt").between(2020, 2030)),
            _entry("mode_level", mode, label, where=mode.isNotNull() & level.isNotNull()),
            _entry("modes_used", b.bucket_label(used, b.MODES_USED), b.bucket_order(used, b.MODES_USED), where=used.isNotNull()),
            *[_entry("adjusted", F.lit(c), where=F.col(c) > 0) for c in ("mode_adj_cnt", "level_adj_cnt")],
        )
    )


def _plain_entries() -> Column:
    """The values under which a session row counts as a row: a histogram of each counter, five-minute buckets of the length."""
    same = F.col("level_adj_cnt") - F.col("level_up_cnt") - F.col("level_down_cnt")
    seconds = F.col("total_duration_sec")
    return F.array_compact(
        F.array(
            *[_entry("counter", F.lit(c), F.col(c)) for c in COUNTER_COLUMNS],
            _entry("counter", F.lit("level_same"), same),
            _entry("duration", b.bucket_label(seconds, b.DURATION_SEC), b.bucket_order(seconds, b.DURATION_SEC), where=seconds.isNotNull()),
        )
    )


def _counted(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("evt_dt", "kind", "k1", "k2", "deviceCode", "prev_any", "prev_model")
        .agg(F.count("useSessionId").alias("sessions"), F.sum("seconds").cast("bigint").alias("seconds"))
        .select(*schemas.column_names(schemas.ROLLUPS))
    )


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("evt_dt", "useSessionId", "deviceCode", "seconds", F.explode("entries").alias("e")).select("*", "e.*").drop("e")


def _with_previous(rows: DataFrame) -> DataFrame:
    """Entries of (evt_dt, useSessionId, deviceCode, seconds, entries) rows with the previous days of the same session and key.

    One shuffle by session serves all windows. Most ids have one day only: these are told apart first and need no previous
    day. An id that comes again holds a row per calendar day at most.
    """
    by_id = Window.partitionBy("useSessionId")
    rows = rows.withColumn("again", F.min("evt_dt").over(by_id) < F.max("evt_dt").over(by_id))
    once = _exploded(rows.where(~F.col("again"))).withColumns({"prev_any": _none("date"), "prev_model": _none("date")})
    key = ["useSessionId", "kind", "k1", "k2"]
    before = F.lag("evt_dt")
    again = _exploded(rows.where("again")).withColumns(
        {
            "prev_any": before.over(Window.partitionBy(*key).orderBy("evt_dt")),
            "prev_model": before.over(Window.partitionBy(*key, "deviceCode").orderBy("evt_dt")),
        }
    )
    return once.unionByName(again)


def session_rollups(sessions: DataFrame, session_modes: DataFrame) -> DataFrame:
    """The roll-up of all given rows; an id's previous days are those among them."""
    none = _none("bigint")
    facts = sessions.select("evt_dt", "useSessionId", "deviceCode", none.alias("seconds"), _distinct_entries().alias("entries"))
    modes = session_modes.select(
        "evt_dt", "useSessionId", "deviceCode", F.col("duration_sec").cast("bigint").alias("seconds"), F.array(_entry("mode", F.col("modeType"))).alias("entries")
    )
    plain = sessions.select("evt_dt", "useSessionId", "deviceCode", none.alias("seconds"), _plain_entries().alias("entries"))
    plain = _exploded(plain).withColumns({"prev_any": _none("date"), "prev_model": _none("date")})
    # Kinds of the three parts differ, so each is counted on its own, map-side first.
    return _counted(_with_previous(facts)).unionByName(_counted(_with_previous(modes))).unionByName(_counted(plain))


def rollups_of_days(sessions: DataFrame, session_modes: DataFrame, index: DataFrame, days: list[date]) -> DataFrame:
    """The roll-up rows of ``days``; of other days only those are read on which a session of ``days`` was seen before."""
    ids = on_days(index, days).select("bucket", "useSessionId").distinct()
    earlier = index.where((F.col("evt_dt") < F.lit(max(days))) & ~F.col("evt_dt").isin(days))
    earlier = earlier.join(ids, ["bucket", "useSessionId"], "left_semi")
    other_days = [r[0] for r in earlier.select("evt_dt").distinct().collect()]  # calendar days

    def near(table: DataFrame) -> DataFrame:
        old = on_days(table, other_days).join(earlier.select("evt_dt", "useSessionId"), ["evt_dt", "useSessionId"], "left_semi")
        return on_days(table, days).unionByName(old.select(*table.columns)) if other_days else on_days(table, days)

    return on_days(session_rollups(near(sessions), near(session_modes)), days)
