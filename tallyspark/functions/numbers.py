"""Ratios in double from exact sums; nulls for a denominator of zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["ratio", "pct", "growth", "decimal_sum", "half_up", "mib"]


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def pct(a: Column, b: Column) -> Column:
    return F.lit(100.0) * ratio(a, b)


def growth(now: Column, then: Column) -> Column:
    """Percent change."""
    return F.lit(100.0) * (ratio(now, then) - F.lit(1.0))


def decimal_sum(c: str | Column) -> Column:
    """An exact sum of money, as decimal(38,4)."""
    return F.sum(c).cast("decimal(38,4)")


def half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def mib(c: Column) -> Column:
    return c.cast("double") / F.lit(1024.0 * 1024.0)
