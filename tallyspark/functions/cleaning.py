"""Form is fixed, content is kept: casts are strict, sentinels become null beside a flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["label", "label_or_null", "money", "clean_date", "count_or_null", "date_or_null", "is_suppressed", "least_count", "most_count"]


def label(c: Column) -> Column:
    return F.trim(c)


def label_or_null(c: Column, marker: str = "-") -> Column:
    return F.nullif(F.trim(c), F.lit(marker))


def money(c: Column) -> Column:
    """Decimal comma to decimal(18,2); anything else fails the query."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).cast("decimal(18,2)")


def clean_date(c: Column) -> Column:
    return F.to_date(F.trim(c))


def count_or_null(c: Column, sentinel: str) -> Column:
    return F.nullif(F.trim(c), F.lit(sentinel)).cast("bigint")


def date_or_null(c: Column) -> Column:
    """yyyyMMdd, with 0 and 00000000 for no date."""
    return F.when(F.trim(c).isin("0", "00000000"), None).otherwise(F.to_date(F.trim(c), "yyyyMMdd"))


def is_suppressed(c: Column, sentinel: str) -> Column:
    return F.trim(c) == sentinel


def least_count(n: Column) -> Column:
    return F.coalesce(n, F.lit(1).cast("bigint"))


def most_count(n: Column, most: int) -> Column:
    return F.coalesce(n, F.lit(most).cast("bigint"))
