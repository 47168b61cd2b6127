"""Calendar periods: truncation, offsets and dense sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRUNC = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_MONTHS = {"M": 1, "Q": 3, "Y": 12}
_STEP = {
    "D": "interval 1 day",
    "W": "interval 7 days",
    "M": "interval 1 month",
    "Q": "interval 3 months",
    "Y": "interval 12 months",
}


def period_start(c: Column, granularity: str) -> Column:
    """First day of the period; weeks start on Monday."""
    if granularity == "D":
        return F.to_date(c)
    return F.to_date(F.date_trunc(_TRUNC[granularity], c))


def shift_periods(c: Column, n: Column | int, granularity: str) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    if granularity == "D":
        return F.date_add(c, n)
    if granularity == "W":
        return F.date_add(c, n * 7)
    return F.add_months(c, n * _MONTHS[granularity])


def period_sequence(start: Column, stop: Column, granularity: str) -> Column:
    return F.sequence(start, stop, F.expr(_STEP[granularity]))
