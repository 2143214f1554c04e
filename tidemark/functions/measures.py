"""Ratios, weighted averages, shares and deltas used by every report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def ratio(num: Column, den: Column, digits: int | None = None) -> Column:
    """num / den, NULL when the base is zero.

    Give whole numbers and fold constants into them (``secs / (60 * users)``): a single division of
    exact values is what makes half-way cases round up the way decimal arithmetic does.
    """
    value = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def hundredths(amount: Column) -> Column:
    """A two-decimal amount as a whole number of hundredths."""
    return F.round(amount * 100).cast("bigint")


def weighted_mean(value: Column, weight: Column, digits: int | None = None) -> Column:
    """Mean of a two-decimal column over groups of different size."""
    return ratio(hundredths(F.sum(value * weight)), F.sum(weight) * 100, digits)


def with_share(df: DataFrame, count: str, digits: int, by: list[str] | None = None, name: str = "pct") -> DataFrame:
    """Add the share of ``count`` in the total, or in the total of its ``by`` group.

    Runs on aggregated rows (a handful of buckets), never on the facts.
    """
    total = F.sum(count).over(Window.partitionBy(*(by or [])))
    return df.withColumn(name, ratio(F.col(count), total, digits))


def delta_pct(new: Column, old: Column) -> Column:
    """Change in percent; NULL when either side is missing or the old one is zero."""
    new, old = new.cast("double"), old.cast("double")
    return F.when(old != 0, F.bround((new - old) / F.abs(old) * 100, 1))


def delta_pp(new: Column, old: Column) -> Column:
    """Change of a 0-1 rate in percentage points."""
    return F.bround((new.cast("double") - old.cast("double")) * 100, 1)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row frames with different columns side by side without a cross join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def first_rows(ranked: DataFrame, top: int | None) -> DataFrame:
    """The first ``top`` rows of a ranking, all for None."""
    return ranked if top is None else ranked.limit(top)
