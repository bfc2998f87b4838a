"""Forecast accuracy: absolute error, and its share of what actually happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.ridge import absolute_error


def score_totals(forecasts: DataFrame) -> DataFrame:
    """Adds day count and error totals to rows with ``actual`` and ``forecast`` arrays."""
    actuals = F.aggregate("actual", F.lit(0.0), lambda acc, v: acc + F.abs(v))
    return forecasts.select(
        "*", F.size("actual").cast("bigint").alias("days"),
        absolute_error(F.col("actual"), F.col("forecast")).alias("absolute_error_total"),
        actuals.alias("absolute_actual_total"),
    )


def pooled(totals: DataFrame, *keys: str) -> DataFrame:
    """MAE and WAPE over every scored day of the keys, from totals and not from rates.

    MAE is NULL without days and WAPE where nothing happened.
    """
    sums = totals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("days").alias("days"),
        F.sum("absolute_error_total").alias("absolute_error_total"),
        F.sum("absolute_actual_total").alias("absolute_actual_total"),
    )
    error, actual = F.col("absolute_error_total"), F.col("absolute_actual_total")
    return sums.select(
        *keys, "folds", "days",
        F.when(F.col("days") > 0, error / F.col("days")).alias("mae"),
        F.when(actual > 0, error / actual * 100).alias("wape_percent"),
        "absolute_error_total", "absolute_actual_total",
    )


def ranked_methods(evaluation: DataFrame) -> DataFrame:
    """Most accurate method first within each series and target, undefined last."""
    return evaluation.orderBy(
        "series_id", "target", F.asc_nulls_last("wape_percent"), "method")


def forecast_total(forecasts: DataFrame) -> DataFrame:
    """Predicted values of the horizon added up per series and target."""
    return forecasts.groupBy("series_id", "target").agg(
        F.sum("predicted_value").alias("forecast_total"))
