"""Usage analytics for connected devices, written as plain Spark DataFrame jobs.

``plans``      raw log -> event, session, session-mode, daily and retention marts
``operators``  reports over those marts (KPIs, trends, distributions, cohorts, firmware, ...)
``functions``  shared Column expressions (ratios, shares, buckets, labels, event fields)
``sources``    reading and writing marts (parquet, JDBC, keyed upsert, day overwrite)
"""

from tidemark.marts import Marts
from tidemark.session import build_session

__all__ = ["Marts", "build_session"]
