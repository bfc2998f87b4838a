"""Calendar scaffolds and zero filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.clock import Period, week_of


def day_scaffold(spark: SparkSession, period: Period) -> DataFrame:
    """Every local day of the period, as ``period_start``."""
    days = F.sequence(F.lit(period.start), F.lit(period.end))
    return spark.range(1).select(F.explode(days).alias("period_start"))


def week_scaffold(spark: SparkSession, period: Period) -> DataFrame:
    """Every Monday whose week meets the period; the first may lie before its start."""
    mondays = F.sequence(
        week_of(F.lit(period.start)), F.lit(period.end), F.expr("INTERVAL 7 DAYS")
    )
    return spark.range(1).select(F.explode(mondays).alias("period_start"))


def scaffold(spark: SparkSession, period: Period, granularity: str) -> DataFrame:
    build = {"day": day_scaffold, "week": week_scaffold}.get(granularity)
    if build is None:
        raise ValueError(f"granularity must be 'day' or 'week', got {granularity!r}")
    return build(spark, period)


def weekday_scaffold(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("iso_weekday")
    )


def hour_grid(spark: SparkSession) -> DataFrame:
    """All 168 (weekday, hour) cells."""
    cells = weekday_scaffold(spark).withColumn(
        "hour", F.explode(F.sequence(F.lit(0), F.lit(23)))
    )
    return cells.select("iso_weekday", "hour")


def fill_gaps(frame: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Every bucket once; measures of buckets that hold nothing are explicit zeros."""
    measures = [c for c in frame.columns if c not in keys]
    filled = buckets.join(frame, keys, "left")
    return filled.select(*keys, *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
                                  for c in measures])
