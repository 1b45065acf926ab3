"""Shorthand for operators: a registered function takes the canonical tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..binding import Star, oracle
from ..registry import register


def op(name: str, sql: str | None = None) -> Callable[[Callable[[Star], DataFrame]], Callable[[Star], DataFrame]]:
    """Registers f(star); sql follows the canonical WITH prefix."""

    def put(f):
        register(name, oracle(sql) if sql else None)(lambda spark, sf_dir: f(Star(spark, sf_dir)))
        return f

    return put


#: Rows of a list whose pairs are all compared, with one side broadcast.
SHORT_ROWS = 20_000


def short(df: DataFrame, rows: int = SHORT_ROWS) -> DataFrame:
    """df, if it has at most so many rows; an error otherwise, as all its pairs would be too many."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} rows, too many to compare each with each")
    return df
