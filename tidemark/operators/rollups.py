"""Distributions read from the roll-up mart: the results of ``operators.distributions`` and ``operators.kpi`` without a scan of sessions.

Every report reads a few rows per day, whatever the number of sessions. Functions have the names and arguments of the
reports they stand for; limits on the length of single session-mode rows are not kept in the mart and stay with those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.measures import first_rows, ratio, with_share
from tidemark.marts import Marts, as_date, in_range


def _rows(marts: Marts, kind: str, start: str, end: str, device_code: str | None) -> DataFrame:
    return in_range(marts.rollups, start, end, device_code).where(F.col("kind") == kind)


def distinct_sessions(start: str, device_code: str | None) -> Column:
    """Sessions of the range: those whose previous day with the same key lies before it."""
    before = F.col("prev_model" if device_code else "prev_any")
    return F.coalesce(F.sum(F.when(before.isNull() | (before < as_date(start)), F.col("sessions"))), F.lit(0))


def _sessions(marts: Marts, kind: str, start: str, end: str, device_code: str | None, *keys: Column) -> DataFrame:
    rows = _rows(marts, kind, start, end, device_code)
    return rows.groupBy(*keys).agg(distinct_sessions(start, device_code).alias("session_count"))


def _labelled(name: str) -> tuple[Column, Column]:
    return F.col("k1").alias(name), F.col("k2").cast("int").alias("bucket_order")


def final_modes(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    counts = _sessions(marts, "final_mode", start, end, device_code, F.col("k1").alias("mode_type"))
    return with_share(counts, "session_count", 5).orderBy(F.desc("session_count"), "mode_type")


def suction_levels(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    counts = _sessions(marts, "level", start, end, device_code, *_labelled("level_bucket"))
    return with_share(counts, "session_count", 5).orderBy("bucket_order")


def top_hours(marts: Marts, start: str, end: str, device_code: str | None = None, top: int | None = 6) -> DataFrame:
    counts = _sessions(marts, "hour", start, end, device_code, F.col("k1").cast("int").alias("local_hour"))
    return first_rows(with_share(counts, "session_count", 5).orderBy(F.desc("session_count"), "local_hour"), top)


def duration_buckets(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _rows(marts, "duration", start, end, device_code)
    counts = rows.groupBy(*_labelled("duration_bucket")).agg(F.sum("sessions").alias("session_count"))
    return with_share(counts, "session_count", 4).orderBy("bucket_order")


def mode_sessions(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    counts = _sessions(marts, "mode", start, end, device_code, F.col("k1").alias("mode_type"))
    return counts.withColumnRenamed("session_count", "cnt").orderBy(F.desc("cnt"), "mode_type")


def mode_minutes(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _rows(marts, "mode", start, end, device_code).groupBy(F.col("k1").alias("mode_type"))
    return rows.agg(ratio(F.sum("seconds"), F.lit(60), 2).alias("duration_min")).orderBy(F.desc("duration_min"), "mode_type")


def mode_sessions_per_user(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    modes = _rows(marts, "mode", start, end, device_code).groupBy("evt_dt", F.col("k1").alias("mode_type"))
    users = in_range(marts.daily, start, end, device_code).groupBy("evt_dt").agg(F.sum("dau").alias("dau"))
    rows = modes.agg(F.sum("sessions").alias("sessions")).join(users, "evt_dt").groupBy("mode_type")
    mean = ratio(F.sum("sessions"), F.sum("dau"), 4).alias("avg_sess_per_user")
    return rows.agg(mean).orderBy(F.desc("avg_sess_per_user"), "mode_type")


def mode_minutes_per_session(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _rows(marts, "mode", start, end, device_code).groupBy(F.col("k1").alias("mode_type"))
    mean = ratio(F.sum("seconds"), distinct_sessions(start, device_code) * 60, 2).alias("avg_dur_per_sess_min")
    return rows.agg(mean).orderBy(F.desc("avg_dur_per_sess_min"), "mode_type")


def mode_session_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _rows(marts, "mode", start, end, device_code).groupBy(F.col("evt_dt").alias("dt"), F.col("k1").alias("mode_type"))
    counts = rows.agg(F.sum("sessions").alias("cnt"))
    return with_share(counts, "cnt", 5, by=["dt"]).orderBy("dt", "mode_type")


def mode_minutes_trend(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _rows(marts, "mode", start, end, device_code).groupBy(F.col("evt_dt").alias("dt"), F.col("k1").alias("mode_type"))
    sums = with_share(rows.agg(F.sum("seconds").alias("sec")), "sec", 5, by=["dt"])
    return sums.select("dt", "mode_type", ratio(F.col("sec"), F.lit(60), 2).alias("dur_min"), "pct").orderBy("dt", "mode_type")


def hours_by_day_type(
    marts: Marts, start: str, end: str, device_code: str | None = None, weekday_source: str = "stored"
) -> DataFrame:
    kind = "event_day_type" if weekday_source == "evt_dt" else "day_type"
    keys = (F.col("k1").alias("is_weekday"), F.col("k2").cast("int").alias("local_hour"))
    shares = with_share(_sessions(marts, kind, start, end, device_code, *keys), "session_count", 5, by=["is_weekday"])
    label = F.when(F.col("is_weekday") == "1", "weekday").otherwise("weekend").alias("day_type")
    return shares.select(label, "local_hour", "session_count", "pct").orderBy("day_type", "local_hour")


def mode_by_level(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    keys = (F.col("k1").alias("final_mode"), F.col("k2").alias("level_bucket"))
    counts = _sessions(marts, "mode_level", start, end, device_code, *keys)
    shares = with_share(counts, "session_count", 4, by=["final_mode"], name="pct_within_mode")
    return shares.orderBy("final_mode", "level_bucket")


def modes_used(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    counts = _sessions(marts, "modes_used", start, end, device_code, *_labelled("mode_mix_type"))
    return with_share(counts, "session_count", 4).orderBy("bucket_order")


# ---- counters ---------------------------------------------------------------------------------------------------------


def _histogram(marts: Marts, start: str, end: str, device_code: str | None) -> DataFrame:
    """(counter, n, sessions): how many session rows hold each value of a counter."""
    rows = _rows(marts, "counter", start, end, device_code)
    return rows.select(F.col("k1").alias("counter"), F.col("k2").cast("bigint").alias("n"), "sessions")


def _total(counter: str) -> Column:
    return F.sum(F.when(F.col("counter") == counter, F.col("n") * F.col("sessions")))


def level_directions(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    named = {"up": "level_up_cnt", "down": "level_down_cnt", "same": "level_same"}
    sums = _histogram(marts, start, end, device_code).agg(*[_total(c).alias(name) for name, c in named.items()])
    rows = sums.unpivot([], list(named), "direction", "adjust_count")
    return with_share(rows.withColumn("n", F.coalesce("adjust_count", F.lit(0))), "n", 4).drop("n")


def adjusts_per_session(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _histogram(marts, start, end, device_code).where(F.col("counter").isin("level_adj_cnt", "mode_adj_cnt"))
    n = F.when(F.col("n") >= 10, F.lit(10)).otherwise(F.col("n"))
    kind = F.substring_index("counter", "_", 1).alias("kind")
    counts = rows.groupBy(kind, n.alias("bucket_order")).agg(F.sum("sessions").alias("session_count"))
    label = F.when(F.col("bucket_order") >= 10, "10+").otherwise(F.col("bucket_order").cast("string"))
    return with_share(counts.withColumn("adj_bucket", label), "session_count", 4, by=["kind"]).orderBy("kind", "bucket_order")


def pause_stats(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = _histogram(marts, start, end, device_code).where((F.col("counter") == "pause_cnt") & F.col("n").isNotNull())
    many = lambda test: F.coalesce(F.sum(F.when(test, F.col("sessions"))), F.lit(0))
    row = rows.agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("total"),
        many(F.col("n") > 0).alias("paused"),
        F.sum(F.col("n") * F.col("sessions")).alias("pauses"),
        *[many(F.col("n") == i).alias(str(i)) for i in range(3)],
        many(F.col("n") >= 3).alias("3+"),
    )
    row = row.withColumn("pause_rate_pct", ratio(F.col("paused") * 100, F.col("total"), 1))
    row = row.withColumn("avg_pauses", ratio(F.col("pauses"), F.col("paused"), 1))
    long = row.unpivot(["pause_rate_pct", "avg_pauses", "total"], ["0", "1", "2", "3+"], "pauses", "cnt")
    # An empty range divides by one, as the published report does.
    share = F.bround(ratio(F.col("cnt"), F.greatest(F.col("total"), F.lit(1))) * 100, 1)
    return long.select("pauses", "pause_rate_pct", "avg_pauses", share.alias("pct"))


def adjust_summary(marts: Marts, start: str, end: str, device_code: str | None = None) -> DataFrame:
    rows = in_range(marts.rollups, start, end, device_code).where(F.col("kind").isin("session", "adjusted", "counter"))
    before = F.col("prev_model" if device_code else "prev_any")
    first = before.isNull() | (before < as_date(start))

    def distinct(test: Column) -> Column:
        return F.sum(F.when(first & test, F.col("sessions")).otherwise(F.lit(0)))

    def changes(counter: str) -> Column:
        this = (F.col("kind") == "counter") & (F.col("k1") == counter)
        return F.sum(F.when(this, F.col("k2").cast("bigint") * F.col("sessions")))

    sessions = distinct(F.col("kind") == "session")

    def rate(counter: str) -> Column:
        return F.bround(ratio(distinct((F.col("kind") == "adjusted") & (F.col("k1") == counter)), sessions) * 100, 1)

    return rows.agg(
        rate("mode_adj_cnt").alias("mode_adj_rate_pct"),
        rate("level_adj_cnt").alias("level_adj_rate_pct"),
        ratio(changes("mode_adj_cnt"), sessions, 2).alias("avg_mode_adj"),
        ratio(changes("level_adj_cnt"), sessions, 2).alias("avg_level_adj"),
    )
