"""Marts built once per session from the test tables, kept as written tables.

The reports read marts; building them anew for each report would hide the cost of the report behind
that of the batch jobs. They go to the shared folder in ``spark.checkpoint.dir``, so losing an
executor costs no rebuild.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import testmap
from tidemark.marts import Marts
from tidemark.plans import state
from tidemark.plans.chain import BUCKETS, run_chain
from tidemark.plans.daily import POWER_ON, build_daily
from tidemark.plans.events import explode_events
from tidemark.plans.retention import build_retention
from tidemark.plans.rollups import session_rollups
from tidemark.session import bound_splits
from tidemark.sources.tables import read_table
from tidemark.sources.writers import write_days

# The last report day of the test log.
LAST_REPORT = "2024-02-07"
# The range of base days of the test retention table.
RETENTION_RANGE = ("2024-01-01", "2024-01-30")

_roots: dict[tuple, str] = {}
_built: dict[tuple, bool] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _stamp(sf_dir: str) -> tuple:
    """Sizes and times of local input files, so that changed input is not served from old marts."""
    if not os.path.isdir(sf_dir):
        return ()
    found = [os.path.join(sf_dir, f"{name}.parquet") for name in ("events", "orders", "customer", "nation", "region")]
    return tuple((os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in found if os.path.exists(p))


class TestMarts:
    """Tables of one scale-factor folder; each is built the first time it is asked for."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        bound_splits(spark)
        self.key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _stamp(sf_dir))
        if self.key not in _roots:
            _roots[self.key] = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        self.root = _roots[self.key]

    def _table(self, name: str, build, dealt: bool = False) -> DataFrame:
        if (self.key, name) not in _built:
            write_days(build(), self.root, name, dealt=dealt)
            _built[(self.key, name)] = True
        return read_table(self.spark, self.root, name)

    @property
    def log(self) -> DataFrame:
        """The raw log, made where it is read: filters on its days leave out the other sessions before any JSON is made."""
        return testmap.raw_log(self.spark, self.sf_dir)

    @property
    def raw(self) -> DataFrame:
        return self._table("raw", lambda: self.log, dealt=True)

    @property
    def events(self) -> DataFrame:
        return self._table("events", lambda: explode_events(self.log), dealt=True)

    @property
    def sessions(self) -> DataFrame:
        return self._table("sessions", lambda: testmap.sessions(self.spark, self.sf_dir))

    @property
    def session_modes(self) -> DataFrame:
        return self._table("session_modes", lambda: testmap.session_modes(self.spark, self.sf_dir))

    @property
    def daily(self) -> DataFrame:
        return self._table("daily", lambda: build_daily(self.sessions, explode_events(self.log, name=POWER_ON)))

    @property
    def retention(self) -> DataFrame:
        return self._table("retention", lambda: build_retention(self.sessions, *RETENTION_RANGE))

    @property
    def activity_bits(self) -> DataFrame:
        return self._table("activity_bits", lambda: state.active_bits(self.sessions))

    @property
    def first_seen(self) -> DataFrame:
        return self._table("first_seen", lambda: state.all_first_seen(self.sessions, self.activity_bits, BUCKETS))

    @property
    def increments(self) -> DataFrame:
        seconds = self.sessions.groupBy("evt_dt", "deviceCode").agg(F.sum("total_duration_sec").alias("seconds"))
        return self._table("increments", lambda: state.increments_from(self.first_seen, seconds))

    @property
    def rollups(self) -> DataFrame:
        return self._table("rollups", lambda: session_rollups(self.sessions, self.session_modes))

    @property
    def nightly(self) -> Marts:
        """A warehouse as nightly runs leave it: a first load that lacks a third of some days, the rest, and the days once more, whole."""
        root = f"{self.root}/nightly"
        if (self.key, "nightly") not in _built:
            late = self.log.where((F.col("dt") < "2024-01-10") | (F.floor(F.col("id") / 100) % 3 != 0))
            run_chain(self.spark, late, root, "2024-01-20", first_report="2024-01-01", dealt=True)
            run_chain(self.spark, self.log, root, LAST_REPORT, first_report="2024-01-21", dealt=True)
            run_chain(self.spark, self.log, root, "2024-01-20", first_report="2024-01-10", dealt=True)
            _built[(self.key, "nightly")] = True
        return Marts.read(self.spark, root)

    @property
    def user_flags(self) -> DataFrame:
        return self._table("user_flags", lambda: testmap.user_flags(self.spark, self.sf_dir))

    @property
    def devices(self) -> DataFrame:
        return self._table("devices", lambda: testmap.devices(self.spark, self.sf_dir))

    def marts(self, *names: str) -> Marts:
        """The named tables only, so that a report triggers no build it does not need."""
        return Marts(**{name: getattr(self, name) for name in names})
