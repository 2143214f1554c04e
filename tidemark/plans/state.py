"""What a nightly run keeps of the past so that it need not read it again: active days as bits, first sightings, increments.

Active days are bit sets of 32 days: a day's bit is its number since 1970-01-01 modulo 32, a row's period the quotient. A changed
day clears and sets its own bit in the rows of its period; retention shifts bits by the offset and compares them, neighbouring
periods carry over. First sightings are a ledger by id: a first day among the changed days is found anew from the bits, which
holds for days that were added and for days that were taken away.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas
from tidemark.plans.retention import OFFSETS, assemble, count_tags, tag
from tidemark.plans.sessions import id_bucket
from tidemark.sources.writers import on_days

SPAN = 32
ALL = (1 << SPAN) - 1
EPOCH = date(1970, 1, 1)
KEYS = ["kind", "id", "deviceCode"]
COUNTED = [f"{scope}_{kind}" for kind in ("users", "devices") for scope in ("model", "new", "any")] + ["model_sessions", "any_sessions"]


def period_of(day: date) -> int:
    return (day - EPOCH).days // SPAN


def active_bits(sessions: DataFrame) -> DataFrame:
    """One row per (period, kind, id, model) with the days of the given sessions; folded map-side. The unknown user is an id too."""
    ids = F.array(
        F.struct(F.lit("user").alias("kind"), F.col("uid").alias("id")),
        F.struct(F.lit("device").alias("kind"), F.col("pump_device_id").alias("id")),
    )
    number = F.unix_date("evt_dt")
    rows = sessions.select(
        F.floor(number / SPAN).cast("int").alias("period"),
        F.expr(f"shiftleft(1L, cast(pmod(unix_date(evt_dt), {SPAN}) as int))").alias("bits"),
        "deviceCode",
        F.explode(ids).alias("e"),
    ).select("period", "e.*", "deviceCode", "bits")
    rows = rows.where((F.col("kind") == "user") | F.col("id").isNotNull())
    return _united(rows)


def _united(rows: DataFrame) -> DataFrame:
    bits = rows.groupBy("period", *KEYS).agg(F.bit_or("bits").alias("bits"))
    return bits.where("bits != 0").select(*schemas.column_names(schemas.ACTIVITY_BITS))


def updated_bits(stored: DataFrame, sessions: DataFrame, days: list[date]) -> DataFrame:
    """The rows of the days' periods after the sessions of ``days`` have been replaced by ``sessions``."""
    masks: dict[int, int] = {}
    for day in days:
        masks[period_of(day)] = masks.get(period_of(day), 0) | 1 << ((day - EPOCH).days % SPAN)
    gone = F.create_map(*[F.lit(x) for period, mask in masks.items() for x in (period, ALL ^ mask)])
    kept = stored.where(F.col("period").isin(list(masks)))
    kept = kept.withColumn("bits", F.col("bits").bitwiseAND(F.element_at(gone, F.col("period")).cast("bigint")))
    return _united(kept.unionByName(active_bits(on_days(sessions, days))))


def first_day(bits: DataFrame) -> DataFrame:
    """(kind, id, model, day): the first active day in the given rows."""
    lowest = F.expr(f"period * {SPAN} + bit_count((bits & -bits) - 1)")
    return bits.groupBy(*KEYS).agg(F.date_from_unix_date(F.min(lowest)).alias("day"))


def first_seen(candidates: DataFrame, buckets: int) -> DataFrame:
    """The ledger from (kind, id, model, day) rows of which the smallest day counts."""
    firsts = candidates.groupBy(*KEYS).agg(F.min("day").alias("day"))
    per_id = Window.partitionBy("kind", "id")  # at most one row per model
    rows = firsts.withColumns(
        {
            "is_new": F.col("day") == F.min("day").over(per_id),
            "is_one": F.row_number().over(per_id.orderBy("day", "deviceCode")) == 1,
            "bucket": id_bucket(buckets, "kind", "id"),
        }
    )
    return rows.select(*schemas.column_names(schemas.FIRST_SEEN))


def seen_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.lit("session").alias("kind"), F.col("useSessionId").alias("id"), "deviceCode", F.col("evt_dt").alias("day"))


def all_first_seen(sessions: DataFrame, bits: DataFrame, buckets: int) -> DataFrame:
    """The ledger of all sessions, for a first run."""
    return first_seen(first_day(bits).unionByName(seen_sessions(sessions)), buckets)


def updated_first_seen(stored: DataFrame, bits: DataFrame, sessions: DataFrame, days: list[date], buckets: int) -> DataFrame:
    """The ledger after the sessions of ``days`` have changed; ``bits`` and ``sessions`` hold them already.

    A first day outside ``days`` still is one unless an earlier day has come up; all others lie on the oldest of ``days`` or
    later. So bits and sessions are read from there on only.
    """
    oldest = min(days)
    kept = stored.where(~F.col("day").isin(days)).select(*KEYS, "day")
    late = first_day(bits.where(F.col("period") >= period_of(oldest)))
    started = seen_sessions(sessions.where(F.col("evt_dt") >= F.lit(oldest)))
    return first_seen(reduce(DataFrame.unionByName, [kept, late, started]), buckets)


def moved_days(before: DataFrame, after: DataFrame) -> list[date]:
    """Days from which or to which the very first day of a user has moved; calendar days."""
    first = lambda rows, name: rows.where("kind = 'user' and is_one").select("id", F.col("day").alias(name))
    both = first(before, "old").unionByName(first(after, "new"), allowMissingColumns=True)
    moves = both.groupBy("id").agg(F.min("old").alias("old"), F.min("new").alias("new"))
    moves = moves.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.explode(F.array("old", "new")).alias("day"))
    return [r[0] for r in moves.where("day is not null").distinct().collect()]


def increments_from(ledger: DataFrame, seconds: DataFrame) -> DataFrame:
    """Rows of the increments from first sightings and (evt_dt, deviceCode, seconds)."""
    counts = []
    for kind in ("user", "device"):
        this = (F.col("kind") == kind) & F.col("id").isNotNull()
        counts += [
            F.count_if(this).alias(f"model_{kind}s"),
            F.count_if(this & F.col("is_new")).alias(f"new_{kind}s"),
            F.count_if(this & F.col("is_one")).alias(f"any_{kind}s"),
        ]
    this = F.col("kind") == "session"
    counts += [F.count_if(this).alias("model_sessions"), F.count_if(this & F.col("is_one")).alias("any_sessions")]
    seen = ledger.groupBy(F.col("day").alias("evt_dt"), "deviceCode").agg(*counts)
    stacked = seen.unionByName(seconds.select("evt_dt", "deviceCode", "seconds"), allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED]
    rows = stacked.groupBy("evt_dt", "deviceCode").agg(*sums, F.sum("seconds").alias("seconds"))
    return rows.select(*schemas.column_names(schemas.INCREMENTS))


# ---- reports ------------------------------------------------------------------------------------------------------


def _back(cur: Column, prev: Column, n: int) -> Column:
    """Bits of days that lie n days after an active one."""
    low = F.shiftrightunsigned(prev, SPAN - n)
    return F.shiftleft(cur, n).bitwiseOR(low).bitwiseAND(F.lit(ALL))


def ahead(cur: Column, following: Column, n: int) -> Column:
    """Bits of days that lie n days before an active one."""
    return F.shiftrightunsigned(cur, n).bitwiseOR(F.shiftleft(following, SPAN - n)).bitwiseAND(F.lit(ALL))


def dates_of(period: Column, bits: Column) -> Column:
    """The dates of a row's bits, in order."""
    set_ = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda j: F.getbit(bits, j) == 1)
    return F.transform(set_, lambda j: F.date_from_unix_date(period * SPAN + j))


def _days(bits: Column) -> Column:
    return dates_of(F.col("period"), bits)


def bits_between(bits: DataFrame, start: date | None, end: date | None) -> DataFrame:
    """Rows of the periods that reach into start..end, their bits cut to it."""
    if start:
        before = F.greatest(F.lit((start - EPOCH).days) - F.col("period") * SPAN, F.lit(0))
        bits = bits.where(F.col("period") >= period_of(start))
        bits = bits.withColumn("bits", F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.col("bits"), before), before))
    if end:
        after = F.greatest(F.col("period") * SPAN + (SPAN - 1) - F.lit((end - EPOCH).days), F.lit(0))
        bits = bits.where(F.col("period") <= period_of(end))
        bits = bits.withColumn("bits", F.col("bits").bitwiseAND(F.call_function("shiftrightunsigned", F.lit(ALL).cast("bigint"), after)))
    return bits.where("bits != 0")


def with_neighbours(bits: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """(kind, id, period) with the bits of the period, ``prev``, ``next``, and ``first``: the bit of the id's first day.

    Every row also names itself to the periods beside its own; one grouping then takes the place of two joins.
    """
    none = F.lit(0).cast("bigint")
    part = lambda name, shift: F.struct((F.col("period") + shift).cast("int").alias("period"), *[(F.col("bits") if n == name else none).alias(n) for n in ("cur", "prev", "next")], none.alias("first"))
    rows = bits.select("kind", "id", F.explode(F.array(part("cur", 0), part("prev", 1), part("next", -1))).alias("p")).select("kind", "id", "p.*")
    if firsts is not None:
        first = firsts.select(
            "kind",
            "id",
            F.floor(F.unix_date("day") / SPAN).cast("int").alias("period"),
            *[none.alias(n) for n in ("cur", "prev", "next")],
            F.expr(f"shiftleft(1L, cast(pmod(unix_date(day), {SPAN}) as int))").alias("first"),
        )
        rows = rows.unionByName(first)
    return rows.groupBy("kind", "id", "period").agg(*[F.bit_or(n).alias(n) for n in ("cur", "prev", "next", "first")])


def retention_from_bits(bits: DataFrame, ledger: DataFrame, days: list[date]) -> DataFrame:
    """The retention rows of the given base days, as ``build_retention`` gives them, without reading sessions."""
    periods = {period_of(d) + n for d in days for n in (-1, 0, 1)}
    near = bits.where(F.col("period").isin(sorted(periods)))
    firsts = ledger.where((F.col("kind") == "user") & F.col("is_one") & F.col("day").isin(days))
    # Ids with the same days in reach are one row with their number: bits are opened into days once for all of them.
    known = F.col("known")
    rows = with_neighbours(near, firsts).withColumn("known", F.col("id").isNotNull())
    rows = rows.groupBy("kind", "known", "period", "cur", "prev", "next", "first").agg(F.count("*").alias("ids"))
    counts = []
    for kind in ("user", "device"):
        tags = [tag(f"base_{kind}s", _days(F.col("cur")))]
        for n in OFFSETS:
            back = F.when(known, F.col("cur").bitwiseAND(_back(F.col("cur"), F.col("prev"), n)))
            tags.append(tag(f"d{n}_retained_{kind}s", _days(back)))
        if kind == "user":
            tags.append(tag("new_users_base", _days(F.col("first"))))
            for n in OFFSETS:
                stayed = F.when(known, F.col("first").bitwiseAND(ahead(F.col("cur"), F.col("next"), n)))
                tags.append(tag(f"cohort_d{n}", _days(stayed)))
        counts.append(count_tags(rows.where(F.col("kind") == kind), tags, F.col("ids")))
    return assemble(counts[0].unionByName(counts[1]), F.array(*[F.lit(d) for d in days]))
