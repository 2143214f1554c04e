"""The nightly batch: raw log -> events -> sessions -> session modes -> daily -> retention, and the state it keeps for the next night."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.plans import state
from tidemark.plans.daily import POWER_ON, activity, daily_rows, power_on_counts, running_totals
from tidemark.plans.events import EVENT_NAME, explode_events, latest_events, latest_rows
from tidemark.plans.retention import affected_days
from tidemark.plans.rollups import rollups_of_days, session_rollups
from tidemark.plans.sessions import build_session_modes, days_and_starts, fold_hours, rebuild_from_index, session_days, session_events
from tidemark.session import bound_splits
from tidemark.sources.tables import read_or_empty, read_table
from tidemark.sources.writers import clear_run, clear_stage, frequent_keys, on_days, publish, replace_days, stage, with_keys, write_days

# Into how many folders ids are dealt by hash. A fixed part of a warehouse: change it by ``rebuild_state`` only.
BUCKETS = 16


def run_chain(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    busi_date: str,
    power_on_by_model: bool = False,
    first_report: str | None = None,
    buckets: int = BUCKETS,
    merge: bool = False,
    dealt: bool = False,
) -> None:
    """Run all jobs for one report day, or for those from ``first_report`` on; a rerun replaces what an earlier run has brought.

    With ``merge`` a rerun adds to it instead: stored events stay unless the log brings a copy written later, so a log of parts, or
    one that holds old copies, cannot undo anything. Where the partitions of ``raw`` hold few days each (``dealt``), as those of a log stored by day
    do, its events are written without a shuffle.

    The rows of the report days, those before and those now, name the event days and the sessions that may have
    changed. Those days are rebuilt whole, however old they are, from all events reported so far; days that come back
    empty are emptied. Daily totals are running totals, so they are renewed from the oldest changed day
    on; retention for the base days at a reported distance of a changed day and for those that first days move from or to.

    What a run is about to change is recorded before anything is touched. A run that was stopped leaves its record, and the next one,
    of whatever report day, takes it over: all steps give the same result when they are repeated, so the tables end up as if
    nothing had happened, but for the report of the stopped run if its events had not been written yet.
    """
    for _ in chain_steps(spark, raw, root, busi_date, power_on_by_model, first_report, buckets, merge, dealt):
        pass


def chain_steps(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    busi_date: str,
    power_on_by_model: bool = False,
    first_report: str | None = None,
    buckets: int = BUCKETS,
    merge: bool = False,
    dealt: bool = False,
) -> Iterator[str]:
    """The steps of ``run_chain``, each named after it has been done."""
    last = date.fromisoformat(busi_date)
    first = date.fromisoformat(first_report or busi_date)
    reported = [first + timedelta(days=n) for n in range((last - first).days + 1)]

    def replace(df: DataFrame, name: str, days: list) -> str:
        replace_days(df, root, name, days, busi_date)
        return name

    # 1. What changes: days are calendar days and come to the driver, ids stay in a table.
    bound_splits(spark)
    raw = raw.where((F.col("eventname") == EVENT_NAME) & F.col("dt").between(F.lit(first), F.lit(last)))
    if merge:
        stored = on_days(read_or_empty(spark, root, "events"), reported, "dt")
        fresh = stage(latest_events(explode_events(raw).unionByName(stored)), root, "events", busi_date)
    else:
        fresh = explode_events(_one_each(raw, f"{root.rstrip('/')}/_staging/{busi_date}/raw_keys"))
        fresh = stage(fresh, root, "events", busi_date, dealt)
    fresh = fresh.select(*schemas.column_names(schemas.EVENTS))
    named = on_days(read_or_empty(spark, root, "events"), reported, "dt").unionByName(fresh)
    known_days, known_ids = read_or_empty(spark, root, "run_days"), read_or_empty(spark, root, "run_ids")
    open_runs = {r[0] for r in known_days.union(known_ids.selectExpr("run", "''", "null")).select("run").distinct().collect()} | {busi_date}
    named = _written(_counted(named), f"{root.rstrip('/')}/_staging/{busi_date}/named")
    days = _days(named) | _noted(known_days, "event")
    ids = named.select("useSessionId").where("useSessionId is not null").union(known_ids.select("useSessionId")).distinct()
    replace(ids.select(F.lit(busi_date).alias("run"), "useSessionId"), "run_ids", [busi_date])
    ids = read_table(spark, root, "run_ids").where(F.col("run") == busi_date).select("useSessionId")
    held, started = days_and_starts(read_or_empty(spark, root, "session_days"), ids, buckets)
    notes = {
        "event": days,
        "start": set(started) | _noted(known_days, "start"),
        "held": set(held) | _noted(known_days, "held"),
        "moved": _noted(known_days, "moved"),
    }
    replace(_notes(spark, busi_date, notes), "run_days", [busi_date])
    yield "record"

    # 2. Events, hours, the index of days by session, sessions and their modes.
    publish(spark, root, "events", reported, busi_date)
    yield "events"
    events, days = read_table(spark, root, "events"), sorted(days, key=str)
    yield replace(fold_hours(on_days(events, days)), "session_hours", days)
    hours = read_table(spark, root, "session_hours")
    yield replace(session_days(on_days(hours, days), buckets), "session_days", days)
    index = read_table(spark, root, "session_days")
    held, started = days_and_starts(index, ids, buckets)
    starts = sorted({d for d in days if d is not None} | notes["start"] | set(started))
    if starts:
        yield replace(rebuild_from_index(hours, index, starts, buckets), "sessions", starts)
        yield replace(build_session_modes(on_days(events, days)), "session_modes", [d for d in days if d is not None])
        # A session is told apart from its earlier days, so all days of a changed session count as changed.
        held = {d for d in {*days, *starts, *notes["held"], *held} if d is not None}
        if read_or_empty(spark, root, "rollups").isEmpty():  # a warehouse from before there were any
            held = _days(index) - {None}
        sessions, modes = read_table(spark, root, "sessions"), read_table(spark, root, "session_modes")
        yield replace(rollups_of_days(sessions, modes, index, sorted(held)), "rollups", sorted(held))
        yield from _renew(spark, root, busi_date, starts, notes, replace, power_on_by_model, buckets)

    # The newest report day has a base row, a report day that is run again may be older.
    newest = max(last, read_or_empty(spark, root, "retention").agg(F.max("base_dt")).first()[0] or date.min)
    bases = affected_days([last, *starts], sorted(notes["moved"]), newest)
    bits, ledger = read_or_empty(spark, root, "activity_bits"), read_or_empty(spark, root, "first_seen")
    write_days(state.retention_from_bits(bits, ledger, bases), root, "retention")
    yield "retention"

    # 4. Nothing is left to take over.
    for run in sorted(open_runs):
        for name in ("run_ids", "run_days"):
            clear_run(spark, root, name, run)
    for name in ("events", "first_seen"):
        clear_stage(spark, root, name, busi_date)
    yield "done"


def _one_each(raw: DataFrame, keys_path: str) -> DataFrame:
    """The rows of the log that make events, the last copy of each (id, dt).

    Keys that come again are found on the two key columns; only their rows are moved and compared, those of all others stay in place.
    """
    again = frequent_keys(raw, ["id", "dt"], 1, keys_path)
    if again.isEmpty():
        return raw
    return with_keys(raw, again, "left_anti").unionByName(latest_rows(with_keys(raw, again)))


def _renew(spark: SparkSession, root: str, run: str, starts: list[date], notes: dict, replace, power_on_by_model: bool, buckets: int) -> Iterator[str]:
    """3. The state and the daily table. Of sessions and events, only the changed days are read; first sightings read session ids
    from the oldest of them on."""
    sessions, events, oldest = read_table(spark, root, "sessions"), read_table(spark, root, "events"), starts[0]
    from_oldest = F.col("evt_dt") >= F.lit(oldest)
    changed = on_days(sessions, starts)

    bits = state.updated_bits(read_or_empty(spark, root, "activity_bits"), changed, starts)
    yield replace(bits, "activity_bits", sorted({state.period_of(d) for d in starts}))
    bits = read_table(spark, root, "activity_bits")

    before = read_or_empty(spark, root, "first_seen")
    after = stage(state.updated_first_seen(before, bits, sessions, starts, buckets), root, "first_seen", run)
    notes["moved"] |= set(state.moved_days(before, after))
    yield replace(_notes(spark, run, notes), "run_days", [run])
    publish(spark, root, "first_seen", list(range(buckets)), run)
    yield "first_seen"
    ledger = read_table(spark, root, "first_seen")

    stored = read_or_empty(spark, root, "increments").where(from_oldest)
    seconds = activity(changed).select("evt_dt", "deviceCode", F.col("total_duration_sec").alias("seconds"))
    seconds = seconds.unionByName(stored.where(~F.col("evt_dt").isin(starts)).select("evt_dt", "deviceCode", "seconds"))
    yield replace(state.increments_from(ledger.where(F.col("day") >= F.lit(oldest)), seconds), "increments", sorted(_days(stored)))

    # Totals of days after the last reported one wait for their report.
    newest = max(date.fromisoformat(run), read_or_empty(spark, root, "retention").agg(F.max("base_dt")).first()[0] or date.min)
    stored = read_or_empty(spark, root, "daily").where(from_oldest)
    untouched = stored.where(~F.col("evt_dt").isin(starts))
    counts = activity(changed.where(F.col("evt_dt") <= F.lit(newest)))
    counts = counts.unionByName(untouched.select(*counts.columns))
    power_ons = power_on_counts(on_days(events, starts), power_on_by_model)
    power_ons = power_ons.unionByName(untouched.select("evt_dt", "deviceCode", "power_on_cnt"), allowMissingColumns=True)
    totals = running_totals(read_table(spark, root, "increments")).where(from_oldest)
    yield replace(daily_rows(counts, totals, power_ons, power_on_by_model), "daily", sorted(_days(stored) | set(starts)))


def rebuild_state(spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
    """The state tables of a warehouse whose sessions were built without them, from whole history."""
    sessions = read_table(spark, root, "sessions")
    write_days(session_days(read_table(spark, root, "session_hours"), buckets), root, "session_days", "static")
    write_days(session_rollups(sessions, read_table(spark, root, "session_modes")), root, "rollups", "static")
    write_days(state.active_bits(sessions), root, "activity_bits", "static")
    write_days(state.all_first_seen(sessions, read_table(spark, root, "activity_bits"), buckets), root, "first_seen", "static")
    seconds = sessions.groupBy("evt_dt", "deviceCode").agg(F.sum("total_duration_sec").alias("seconds"))
    write_days(state.increments_from(read_table(spark, root, "first_seen"), seconds), root, "increments", "static")


def _counted(events: DataFrame) -> DataFrame:
    """(useSessionId, evt_dt) of events that a session, a mode or a daily total counts; power-ons, which are no session's, without an id."""
    rows = events.select("eventName", "evtType", "useSessionId", "evt_dt")
    power_ons = rows.where(F.col("eventName") == POWER_ON).withColumn("useSessionId", F.lit(None).cast("string"))
    return session_events(rows).unionByName(power_ons).select("useSessionId", "evt_dt").distinct()


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _days(rows: DataFrame) -> set:
    return {r[0] for r in rows.select("evt_dt").distinct().collect()}


def _notes(spark: SparkSession, run: str, notes: dict[str, set]) -> DataFrame:
    rows = [(run, what, day) for what, days in notes.items() for day in sorted(days, key=str)]
    return spark.createDataFrame(rows, schemas.RUN_DAYS)


def _noted(run_days: DataFrame, what: str) -> set:
    """Calendar days that unfinished runs have noted."""
    return {r[0] for r in run_days.where(F.col("what") == what).select("day").distinct().collect()}
