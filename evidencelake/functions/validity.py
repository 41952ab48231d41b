"""Inclusive validity periods; a missing end is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def effective_on(day: Column, start: Column, end: Column) -> Column:
    """Whether ``day`` lies in the inclusive period."""
    return (day >= start) & (end.isNull() | (day <= end))


def end_or_open(end: Column) -> Column:
    return F.coalesce(end, F.to_date(F.lit(OPEN_END)))


def selection_status(review_status: Column, day: Column, start: Column, end: Column) -> Column:
    """First reason an entry is skipped for a snapshot; NULL means selected."""
    return (
        F.when(review_status != "reviewed", "not_reviewed")
        .when(start.isNull() | (day < start), "not_yet_effective")
        .when(end.isNotNull() & (day > end), "expired")
    )


def month_of(day: Column) -> Column:
    """Months since year zero, the equi key of bucketed range joins."""
    return F.year(day) * 12 + F.month(day)


def catalog_date(text: Column) -> Column:
    """ISO date or timestamp text to a date, in the offset it was written in."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd"))
