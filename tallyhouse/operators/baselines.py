"""Transparent forecasters, as array expressions over each series' history.

``history`` is a column of values that ends the day before the forecast starts, so no
method can read what it predicts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK = 7


def _steps(horizon: int) -> Column:
    return F.sequence(F.lit(0), F.lit(horizon - 1))


def _same_weekday(history: Column, step: Column, weeks_back: int) -> Column:
    """Value on step's weekday in the last observed week, or some weeks before it."""
    at = F.size(history) - WEEK + step % WEEK - WEEK * weeks_back
    return F.get(history, at)


def seasonal_naive(history: Column, horizon: int) -> Column:
    """The last observed week, repeated."""
    return F.transform(_steps(horizon), lambda s: _same_weekday(history, s, 0))


def same_weekday_mean(history: Column, horizon: int, occurrences: int = 4) -> Column:
    """Mean of the latest occurrences of the weekday that the history holds."""
    if occurrences < 1:
        raise ValueError("occurrences must be at least 1")
    backs = F.sequence(F.lit(0), F.lit(occurrences - 1))

    def mean(step: Column) -> Column:
        at = F.size(history) - WEEK + step % WEEK
        seen = F.transform(F.filter(backs, lambda b: at - b * WEEK >= 0),
                           lambda b: F.get(history, at - b * WEEK))
        return F.aggregate(seen, F.lit(0.0), lambda acc, v: acc + v) / F.size(seen)

    return F.transform(_steps(horizon), mean)


def trailing_mean(history: Column, horizon: int, days: int = 28) -> Column:
    """Flat mean of the last days; the control a weekday-aware method must beat."""
    recent = F.slice(history, F.size(history) - days + 1, days)
    mean = F.aggregate(recent, F.lit(0.0), lambda acc, v: acc + v) / days
    return F.array_repeat(mean, horizon)


# Method name to (column function, fewest days of history).
BASELINES = {
    "seasonal_naive": (seasonal_naive, 7),
    "same_weekday_mean_4": (same_weekday_mean, 28),
    "trailing_mean_28": (trailing_mean, 28),
}
