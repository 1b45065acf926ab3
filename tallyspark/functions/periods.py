"""Periods are compared by exact month ends, never by the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["month_end", "months_back", "quarter_end", "month_of", "quarter_of_code", "crosses", "months_between_starts"]


def month_end(c: Column) -> Column:
    return F.last_day(c.cast("date"))


def months_back(month: Column, n: int | Column) -> Column:
    """The month end n months earlier."""
    return F.last_day(F.add_months(month, -n))


def quarter_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year.cast("int"), (quarter * 3).cast("int"), F.lit(1)))


def month_of(code: Column) -> Column:
    """yyyyMM to a month end."""
    return F.last_day(F.to_date(code, "yyyyMM"))


def quarter_of_code(code: Column) -> Column:
    """yyyyQQ to the quarter's last day."""
    return quarter_end(F.substring(code, 1, 4).cast("int"), F.substring(code, 5, 2).cast("int"))


def crosses(before: Column, now: Column, at: Column) -> Column:
    """before < at <= now."""
    return (before < at) & (at <= now)


def months_between_starts(a: Column, b: Column) -> Column:
    return F.months_between(F.trunc(a, "MM"), F.trunc(b, "MM")).cast("bigint")
