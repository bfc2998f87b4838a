"""Regression features of a day, each from values strictly before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.clock import is_fixed_holiday
from tallyhouse.operators.series import by_target

LAGS = (7, 14, 21, 28)
MEANS = (7, 28)
MIN_HISTORY = 28


def feature_names(include_month: bool = False, include_holiday: bool = False) -> list[str]:
    names = [f"weekday_{d}" for d in range(1, 7)]
    names += [f"lag_{k}" for k in LAGS] + [f"trailing_mean_{k}" for k in MEANS]
    if include_month:
        names += [f"month_{m}" for m in range(2, 13)]
    if include_holiday:
        names.append("is_fixed_holiday")
    return names


def design_matrix(
    series: DataFrame, include_month: bool = False, include_holiday: bool = False
) -> DataFrame:
    """Feature rows with their ``value`` for every day that has 28 days behind it.

    Monday is the reference weekday. Frames end at the previous row, so a day never sees
    itself; the series must be contiguous.
    """
    in_order = Window.partitionBy("series_id", "target").orderBy("day")
    value = F.col("value")

    def flag(condition):
        return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))

    columns = [flag(F.weekday("day") == d).alias(f"weekday_{d}") for d in range(1, 7)]
    columns += [F.lag(value, k).over(in_order).cast("double").alias(f"lag_{k}") for k in LAGS]
    columns += [F.avg(value).over(in_order.rowsBetween(-k, -1)).alias(f"trailing_mean_{k}")
                for k in MEANS]
    if include_month:
        columns += [flag(F.month("day") == m).alias(f"month_{m}") for m in range(2, 13)]
    if include_holiday:
        columns.append(flag(is_fixed_holiday(F.col("day"))).alias("is_fixed_holiday"))
    rows = by_target(series).select(
        "series_id", "target", "day", value.cast("double").alias("value"), *columns,
        F.row_number().over(in_order).alias("position"),
    )
    return rows.filter(F.col("position") > MIN_HISTORY).drop("position")
