"""The next days of every series, with the method's historical accuracy beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.ridge import FLOORED, forecast_paths, selected_paths
from tallyhouse.operators.series import TARGETS, histories
from tallyhouse.plans import backtest
from tallyhouse.plans.evaluations import EvaluationStore
from tallyhouse.plans.methods import METHODS
from tallyhouse.plans.settle import settled

MAX_HORIZON = 14
# What each target's predictions count.
UNITS = {"net_sales_pence": "pence", "payment_order_count": "orders", "net_units": "units"}


class InsufficientHistory(ValueError):
    """Some series are too short to forecast."""


def whole_prediction(value, target):
    """Whole pence or counts, half to even; counts are never negative."""
    rounded = F.bround(value, 0).cast("bigint")
    return F.when(target.isin(*FLOORED), F.greatest(rounded, F.lit(0).cast("bigint"))
                  ).otherwise(rounded)


def forecast(series: DataFrame, targets: tuple[str, ...] = ("net_sales_pence",),
             horizon: int = MAX_HORIZON, with_accuracy: bool = True,
             strict: bool = False, evaluations: EvaluationStore | None = None) -> DataFrame:
    """One row per series, target and future day.

    Series too short for one backtest fold have one row per target with a status and nulls;
    ``strict`` raises for them. Days already carry the last training day, so rows can be
    told from observations by themselves. With ``evaluations``, the accuracy of a series that
    was scored before is read from there, and only changed series are backtested.
    """
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must be between 1 and {MAX_HORIZON}, got {horizon}")
    unknown = set(targets) - set(TARGETS)
    if unknown:
        raise ValueError(f"unknown targets {sorted(unknown)}")
    series = settled(series)
    short = backtest.short_series(series)
    first = short.take(5) if strict else []
    if first:
        raise InsufficientHistory("; ".join(
            f"{r.series_id}: {r.days} day(s), at least {r.required_days} required" for r in first))
    series = series.join(short, "series_id", "left_anti")

    packed = histories(series, targets).withColumn("origins", F.array(F.size("values")))
    chosen = selected_paths(forecast_paths(packed, horizon), horizon)
    ends = series.groupBy("series_id").agg(F.max("day").alias("trained_through"))
    points = chosen.join(ends, "series_id").select(
        "series_id", "target", "trained_through",
        F.posexplode("forecast").alias("at", "value"),
    ).select(
        "series_id", "target", F.date_add("trained_through", F.col("at") + 1).alias("date"),
        whole_prediction(F.col("value"), F.col("target")).alias("predicted_value"),
        F.lit(backtest.RIDGE_METHOD).alias("method"), "trained_through",
        F.date_add("trained_through", 1).alias("forecast_start"),
        F.date_add("trained_through", horizon).alias("forecast_end"),
        F.lit(horizon).alias("horizon_days"),
        F.element_at(F.create_map(*[F.lit(x) for p in UNITS.items() for x in p]),
                     F.col("target")).alias("unit"),
    )
    if not with_accuracy:
        return backtest.with_short_series(points, short, targets)
    if evaluations is None:
        scored = backtest.evaluate(backtest.ridge_folds(series, targets=targets))
    else:
        scored = evaluations.evaluate(backtest.fold_histories(series, targets=targets),
                                      [METHODS[backtest.RIDGE_METHOD]], backtest.HORIZON)
    measured = scored.select(
        "series_id", "target", F.col("wape_percent").alias("historical_wape_percent"),
        F.col("mae").alias("historical_mae"), F.col("folds").alias("backtest_folds"),
        F.lit(backtest.HORIZON).alias("backtest_horizon_days"),
        (F.col("folds") * backtest.HORIZON).alias("evaluated_days"),
    )
    return backtest.with_short_series(
        points.join(measured, ["series_id", "target"], "left"), short, targets)
