"""Totals per trading day that add up, so that series read days and not orders.

Every import keeps the totals of the orders it brought. An order belongs to one import, so the
sum over imports equals the totals of all orders, however the extractions overlapped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import clock
from tallyhouse.functions.clock import Period
from tallyhouse.operators import calendar
from tallyhouse.operators.orders import SERIES_MEASURES, measures

MEASURES = (*SERIES_MEASURES, "refund_event_count")


def day_totals(orders: DataFrame, zone: str, *keys: str) -> DataFrame:
    """The shared measures per local day and key."""
    return orders.groupBy(
        *keys, clock.local_day(F.col("occurred_at"), zone).alias("day")
    ).agg(*measures()).select(*keys, "day", *MEASURES)


def merged(totals: DataFrame, *keys: str) -> DataFrame:
    """Totals of several imports added up per key."""
    return totals.groupBy(*keys).agg(*[F.sum(m).cast("bigint").alias(m) for m in MEASURES])


def revenue_of_days(days: DataFrame, period: Period, granularity: str = "day") -> DataFrame:
    """`revenue_series` from day totals of the period's zone; several rows of a day add up."""
    inside = days.filter(F.col("day").between(F.lit(period.start), F.lit(period.end)))
    start = {"day": F.col("day"), "week": clock.week_of(F.col("day"))}.get(granularity)
    if start is None:
        raise ValueError(f"granularity must be 'day' or 'week', got {granularity!r}")
    found = merged(inside.withColumn("period_start", start), "period_start").select(
        "period_start", *SERIES_MEASURES)
    buckets = calendar.scaffold(days.sparkSession, period, granularity)
    return calendar.fill_gaps(found, buckets, ["period_start"]).orderBy("period_start")
