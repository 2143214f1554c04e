"""Shaping of finished result frames for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.measures import first_rows, ratio

# Bars shown, and the smallest scale of a percent and of a numeric bar list.
TOP_BARS = 6
PERCENT_FLOOR = 1.0
NUMBER_FLOOR = 0.001


def clip(rows: DataFrame, start: str, end: str, day: str = "dt") -> DataFrame:
    """Rows of start..end by ``day``, or by ``base_date`` where ``day`` is missing."""
    columns = [F.col(c).cast("date") for c in (day, "base_date") if c in rows.columns]
    return rows.where(F.coalesce(*columns).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def shares(rows: DataFrame, value: str) -> DataFrame:
    """Add ``pct``: percent of the total with one decimal, 0 when the total is 0.

    The total is folded where the rows are and comes as a scalar, so the rows, however many, stay where they are.
    """
    amount = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    total = rows.agg(F.sum(amount)).scalar()
    return rows.withColumn("pct", F.when(total > 0, F.round(amount / total * 100, 1)).otherwise(0.0))


def _bars(rows: DataFrame, value: Column, floor: float) -> DataFrame:
    top = F.greatest(rows.agg(F.max(value)).scalar(), F.lit(floor))
    return rows.withColumn("bar_value", value).withColumn("bar_width", F.floor(ratio(value, top) * 100 + 0.5))


def percent_bars(rows: DataFrame, pct: str, order: list, is_ratio: bool = True, top: int | None = TOP_BARS) -> DataFrame:
    """The first six rows in ``order``, all of them for ``top=None``, with a bar width of 0-100 relative to the largest of all rows."""
    value = F.coalesce(F.col(pct).try_cast("double"), F.lit(0.0))
    if is_ratio:
        value = F.when(value <= 1, value * 100).otherwise(value)
    return first_rows(_bars(rows, value, PERCENT_FLOOR).orderBy(*order), top)


def number_bars(rows: DataFrame, value: str, order: list, top: int | None = None) -> DataFrame:
    """All rows in ``order``, or the first ``top``, with a bar width of 0-100 relative to the largest of all rows."""
    amount = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    return first_rows(_bars(rows, amount, NUMBER_FLOOR).orderBy(*order), top)
