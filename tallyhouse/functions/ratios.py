"""Shares, period-on-period change and association measures. Undefined is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL unless ``whole`` is positive."""
    return F.when(
        whole > 0, F.round(part.cast("double") * 100 / whole.cast("double"), places)
    )


def movement_status(current: Column, previous: Column) -> Column:
    """Whether a percentage change against the previous period is defined, and if not why."""
    return (
        F.when(previous > 0, F.lit("comparable"))
        .when((previous == 0) & (current != 0), F.lit("new_in_period"))
        .otherwise(F.lit("not_comparable"))
    )


def percent_change(current: Column, previous: Column) -> Column:
    return percent(current - previous, previous, 2)


def revenue_direction(change: Column) -> Column:
    return (
        F.when(change > 0, F.lit("increasing"))
        .when(change < 0, F.lit("decreasing"))
        .otherwise(F.lit("unchanged"))
    )


def lift(pair: Column, a: Column, b: Column, eligible: Column) -> Column:
    """Observed co-occurrence over what independence predicts, from counts; 4 places."""
    together = pair.cast("double") * eligible.cast("double")
    apart = a.cast("double") * b.cast("double")
    return F.when((eligible > 0) & (a > 0) & (b > 0), F.round(together / apart, 4))
