"""Parameters of the models, with the defaults the queries use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    #: Amounts of a group below which it gets no verdict, and groups a product needs at least.
    cut: float = 50_000.0
    least_groups: int = 3
    #: Months between the compared rates and between the compared gaps.
    rate_months: int = 6
    growth_months: int = 12
    #: The level step of the second version, and the last month with whole data.
    break_month: str = "2000-01-31"
    end: str = "2001-08-01"
    #: Least values of a suppressed and of a disclosed count.
    suppressed_most: int = 5
    #: Relative tolerance of totals.
    tolerance: float = 1e-9


DEFAULT = Params()
