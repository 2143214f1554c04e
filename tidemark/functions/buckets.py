"""Bucket tables and the expression that applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (lowest, highest, label, order key); the last entry catches everything else.
SUCTION_LEVEL = [(1, 3, "1-3", 1), (4, 6, "4-6", 2), (7, 9, "7-9", 3), (None, None, "9+", 4)]
STREAK_DAYS = [
    (1, 1, "1 day", 1),
    (2, 3, "2-3 days", 2),
    (4, 7, "4-7 days", 4),
    (8, 14, "8-14 days", 8),
    (15, 30, "15-30 days", 15),
    (None, None, "30+ days", 31),
]
SESSIONS_PER_DAY = [
    (1, 1, "1", 1),
    (2, 2, "2", 2),
    (3, 3, "3", 3),
    (4, 4, "4", 4),
    (5, 5, "5", 5),
    (6, 10, "6-10", 6),
    (11, 20, "11-20", 11),
    (None, None, "21+", 21),
]
SESSIONS_PER_DAY_SHORT = [(1, 1, "1", 1), (2, 2, "2", 2), (3, 3, "3", 3), (4, 5, "4-5", 4), (None, None, "6+", 6)]
SESSIONS_IN_TOTAL = [
    (1, 1, "1", 1),
    (2, 5, "2-5", 2),
    (6, 10, "6-10", 6),
    (11, 20, "11-20", 11),
    (21, 50, "21-50", 21),
    (51, 100, "51-100", 51),
    (None, None, "100+", 101),
]
DURATION_SEC = [
    (None, 299, "0-5 min", 1),
    (300, 599, "5-10 min", 2),
    (600, 899, "10-15 min", 3),
    (900, 1199, "15-20 min", 4),
    (1200, 1499, "20-25 min", 5),
    (1500, 1799, "25-30 min", 6),
    (1800, 2099, "30-35 min", 7),
    (2100, 2399, "35-40 min", 8),
    (2400, 2699, "40-45 min", 9),
    (None, None, "45+ min", 10),
]
MODES_USED = [(1, 1, "single", 1), (2, 2, "two", 2), (3, 2**31 - 1, "three or more", 3), (None, None, "unknown", 4)]


def _pick(value: Column, spec: list[tuple], item: int) -> Column:
    *ranges, rest = spec
    out = None
    for low, high, *labels in ranges:
        test = value <= high if low is None else value.between(low, high)
        out = F.when(test, labels[item]) if out is None else out.when(test, labels[item])
    return out.otherwise(rest[2 + item])


def bucket_label(value: Column, spec: list[tuple]) -> Column:
    return _pick(value, spec, 0)


def bucket_order(value: Column, spec: list[tuple]) -> Column:
    return _pick(value, spec, 1)


def with_bucket(df: DataFrame, value: Column, spec: list[tuple], label: str, order: str = "bucket_order") -> DataFrame:
    return df.withColumns({label: bucket_label(value, spec), order: bucket_order(value, spec)})


def suction_level(level: Column) -> Column:
    """Levels are stored as text; what is not a number lands in the last bucket."""
    return level.try_cast("int")
