"""Sessions -> retention per observation day, for a whole range of days in one job."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.functions.measures import ratio
from tidemark.plans.daily import as_table

# Fixed value: the day distances that are reported.
OFFSETS = (1, 7, 14)


def active_days(sessions: DataFrame, key: str = "uid") -> DataFrame:
    """One row per id with the set of days it was active: (id, days).

    Partial sets are merged map-side, so the shuffle carries one short array per id and map task
    instead of sessions. An array never holds more than one entry per calendar day.
    """
    return sessions.groupBy(F.col(key).alias("id")).agg(F.collect_set("evt_dt").alias("days"))


def returned(days: Column, offset: int) -> Column:
    """The days on which the id was active and had been active ``offset`` days before."""
    return F.array_intersect(days, F.transform(days, lambda day: F.date_add(day, offset)))


def tag(name: str, days: Column) -> Column:
    return F.transform(days, lambda day: F.struct(F.lit(name).alias("what"), day.alias("day")))


def affected_days(changed: list[date], first_days: list[date], last: date) -> list[date]:
    """Base days whose row may change with the sessions of the ``changed`` days and the given first days of users."""
    near = {d + timedelta(days=n) for d in changed for n in (0, *OFFSETS, *(-n for n in OFFSETS))}
    return sorted(d for d in near | set(first_days) if d <= last)


def build_retention(
    sessions: DataFrame, start: str, end: str, drop_null_uid: bool = False, days: list[date] | None = None
) -> DataFrame:
    """One row per base_dt in start..end, model 'ALL'; only for those of ``days`` if given.

    Day sets are compared inside one row per user (or device): a single shuffle by id replaces the
    pairwise joins of per-day user sets, and all base days come out of the same job. The unknown user (NULL uid) counts
    once in a day's base and among its new users but never as retained; ``drop_null_uid`` leaves it out altogether.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    near = F.col("evt_dt").between(F.date_sub(first, max(OFFSETS)), F.date_add(last, max(OFFSETS)))
    if days is not None:
        near = F.col("evt_dt").isin(sorted({d + timedelta(days=n) for d in days for n in (0, *OFFSETS, *(-n for n in OFFSETS))}))
    users = sessions.where(F.col("uid").isNotNull()) if drop_null_uid else sessions

    # A user's first day comes from all history, the day set from the near range only.
    user_days = users.groupBy(F.col("uid").alias("id")).agg(
        F.min("evt_dt").alias("first_day"), F.collect_set(F.when(near, F.col("evt_dt"))).alias("days")
    )
    device_days = active_days(sessions.where(near & F.col("pump_device_id").isNotNull()), "pump_device_id")
    counts = count_tags(user_days, _activity("users") + _cohort()).unionByName(count_tags(device_days, _activity("devices")))
    return assemble(counts, F.sequence(first, last) if days is None else F.array(*[F.lit(d) for d in days]))


def _activity(kind: str) -> list[Column]:
    tags = [tag(f"base_{kind}", F.col("days"))]
    for n in OFFSETS:
        tags.append(tag(f"d{n}_retained_{kind}", F.when(F.col("id").isNotNull(), returned(F.col("days"), n))))
    return tags


def _cohort() -> list[Column]:
    """New users on their first day, and those of them active exactly n days later."""
    first_day = F.array("first_day")
    tags = [tag("new_users_base", first_day)]
    for n in OFFSETS:
        stayed = F.col("id").isNotNull() & F.array_contains("days", F.date_add("first_day", n))
        tags.append(tag(f"cohort_d{n}", F.when(stayed, first_day)))
    return tags


def count_tags(day_sets: DataFrame, tags: list[Column], ids: Column | None = None) -> DataFrame:
    """How many ids have a day under a tag; a row stands for as many as ``ids`` says, for one if it is not given."""
    none = F.array().cast("array<struct<what:string,day:date>>")
    tagged = F.concat(*[F.coalesce(t, none) for t in tags])
    rows = day_sets.select(F.explode(tagged).alias("t"), (F.lit(1) if ids is None else ids).cast("bigint").alias("ids"))
    return rows.groupBy("t.what", "t.day").agg(F.sum("ids").alias("n"))


def assemble(counts: DataFrame, base_days: Column) -> DataFrame:
    """Tagged day counts -> one wide row per base_dt; works on a few rows per day."""
    # A base set of day d is the denominator of d+1, d+7 and d+14.
    shift = F.when(
        F.col("what").isin("base_users", "base_devices"),
        F.array(*[F.struct(F.concat(F.lit(f"b{n}_"), "what").alias("what"), F.date_add("day", n).alias("base_dt")) for n in OFFSETS]),
    ).otherwise(F.array(F.struct(F.col("what"), F.col("day").alias("base_dt"))))
    long = counts.select("n", F.explode(shift).alias("s")).select("n", "s.*")

    names = [f"b{n}_base_{kind}" for kind in ("users", "devices") for n in OFFSETS]
    names += [f"d{n}_retained_{kind}" for kind in ("users", "devices") for n in OFFSETS]
    names += ["new_users_base"] + [f"cohort_d{n}" for n in OFFSETS]
    spine = counts.sparkSession.range(1).select(
        F.explode(base_days).alias("base_dt"), F.lit("").alias("what"), F.lit(0).cast("bigint").alias("n")
    )
    wide = (
        long.where(F.array_contains(base_days, F.col("base_dt")))
        .unionByName(spine)
        .groupBy("base_dt")
        .agg(*[F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in names])
    )
    columns = {"deviceCode": F.lit("ALL")}
    for kind, one in (("users", "user"), ("devices", "device")):
        columns[f"base_{kind}"] = F.col(f"b1_base_{kind}")
        for n in OFFSETS:
            columns[f"d{n}_{one}_ret"] = ratio(F.col(f"d{n}_retained_{kind}"), F.col(f"b{n}_base_{kind}"), 5)
    for n in OFFSETS:
        columns[f"cohort_d{n}_ret"] = ratio(F.col(f"cohort_d{n}"), F.col("new_users_base"), 5)
    return as_table(wide.withColumns(columns), schemas.RETENTION)
