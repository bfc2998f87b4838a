"""Rolling-origin evaluation of every method on every target of every series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.baselines import BASELINES
from tallyhouse.operators.scoring import pooled, score_totals
from tallyhouse.operators.series import TARGETS, SeriesIntegrityError, histories
from tallyhouse.plans.evaluations import EvaluationStore
from tallyhouse.plans.methods import Method, chosen, method_folds, ridge_method
from tallyhouse.plans.settle import settled

HORIZON = 14
FIRST_ORIGIN = 120
RIDGE_METHOD = "ridge_holiday"
# What a backtest compares unless told otherwise; other methods are asked for by name.
DEFAULT_METHODS = (*BASELINES, RIDGE_METHOD)
SHORT = "insufficient_history"


def fold_origins(length: Column, horizon: int = HORIZON, first: int = FIRST_ORIGIN,
                 step: int | None = None) -> Column:
    """Training lengths of all folds of a series; empty when it is too short for one.

    The step defaults to the horizon, so every evaluated day is scored once.
    """
    stride = horizon if step is None else step
    if min(horizon, first, stride) < 1:
        raise ValueError("horizon, first origin and step must be at least 1")
    last = length - horizon
    return F.when(last >= first, F.sequence(F.lit(first), last.cast("int"), F.lit(stride))
                  ).otherwise(F.array().cast("array<int>"))


def folds(series: DataFrame, horizon: int = HORIZON, first: int = FIRST_ORIGIN,
          step: int | None = None) -> DataFrame:
    """``series_id, fold, origin`` with the first and last day each fold is scored on."""
    spans = series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"))
    origins = fold_origins(F.col("n"), horizon, first, step)
    return spans.select(
        "series_id", "first_day", F.posexplode(origins).alias("fold", "origin")
    ).select(
        "series_id", "fold", "origin",
        F.date_add("first_day", F.col("origin")).alias("first_test_day"),
        F.date_add("first_day", F.col("origin") + horizon - 1).alias("last_test_day"),
    )


def fold_histories(
    series: DataFrame, horizon: int = HORIZON, first: int = FIRST_ORIGIN,
    step: int | None = None, targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """Each series and target as one array with the training lengths of its folds."""
    return histories(series, tuple(targets)).withColumn(
        "origins", fold_origins(F.size("values"), horizon, first, step)
    ).filter(F.size("origins") > 0)


def _methods(names: Sequence[str | Method], first: int) -> list[Method]:
    """The methods asked for, none of which needs more days than the first fold has."""
    found = chosen(names)
    for method in found:
        if first < method.min_history:
            raise SeriesIntegrityError(f"{method.name} needs {method.min_history} days but the "
                                       f"first fold trains on {first}")
    return found


def baseline_folds(
    series: DataFrame, methods: Sequence[str] = tuple(BASELINES), horizon: int = HORIZON,
    first: int = FIRST_ORIGIN, step: int | None = None, targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """Forecast and held-out arrays of the baselines, one row per fold and method."""
    return method_folds(fold_histories(series, horizon, first, step, targets),
                        _methods(methods, first), horizon)


def ridge_folds(
    series: DataFrame, horizon: int = HORIZON, first: int = FIRST_ORIGIN,
    step: int | None = None, targets: Sequence[str] = TARGETS,
    include_month: bool = False, include_holiday: bool = True,
) -> DataFrame:
    """The same for ridge, with the penalty chosen inside each training window."""
    method = ridge_method(include_month, include_holiday)
    return method_folds(fold_histories(series, horizon, first, step, targets),
                        _methods([method], first), horizon)


def fold_scores(folded: DataFrame) -> DataFrame:
    """MAE and WAPE of every single fold."""
    return pooled(score_totals(folded), "series_id", "target", "method", "origin")


def evaluate(folded: DataFrame) -> DataFrame:
    """One row per series, target and method, pooled over all folds."""
    return pooled(score_totals(folded), "series_id", "target", "method")


def short_series(series: DataFrame, first: int = FIRST_ORIGIN,
                 horizon: int = HORIZON) -> DataFrame:
    """Series too short for one fold: ``series_id, days, required_days``."""
    return series.groupBy("series_id").agg(F.count(F.lit(1)).alias("days")).filter(
        F.col("days") < first + horizon).select(
        "series_id", "days", F.lit(first + horizon).cast("bigint").alias("required_days"))


def series_status(series: DataFrame, first: int = FIRST_ORIGIN, horizon: int = HORIZON) -> DataFrame:
    """Every series with its days, the days required, its folds and `evaluated` or `SHORT`."""
    spans = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("days"))
    return spans.select(
        "series_id", "days", F.lit(first + horizon).cast("bigint").alias("required_days"),
        F.size(fold_origins(F.col("days"), horizon, first)).cast("bigint").alias("folds"),
        F.when(F.col("days") < first + horizon, F.lit(SHORT)).otherwise(F.lit("evaluated")).alias("status"))


def with_short_series(found: DataFrame, short: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Results with a status, and a row of nulls for each target of each series too short for any."""
    missing = short.select("series_id", F.explode(F.array(*map(F.lit, targets))).alias("target"),
                           F.lit(SHORT).alias("status"))
    return found.withColumn("status", F.lit("evaluated")).unionByName(missing, allowMissingColumns=True)


def run_backtest(series: DataFrame, horizon: int = HORIZON, first: int = FIRST_ORIGIN,
                 step: int | None = None, targets: Sequence[str] = TARGETS,
                 strict: bool = False, methods: Sequence[str | Method] = DEFAULT_METHODS,
                 evaluations: EvaluationStore | None = None) -> DataFrame:
    """Methods, by name or as `Method`, on the same folds.

    Series without a fold have one row per target with a status and nulls; ``strict`` raises
    for them. The histories are settled first: they are tiny next to the orders they came from,
    and every method reads them. With ``evaluations``, results of unchanged histories are read
    from there and ``reused`` tells which.
    """
    tried = _methods(methods, first)
    series = settled(series)
    short = short_series(series, first, horizon)
    named = short.take(5) if strict else []
    if named:
        raise SeriesIntegrityError("; ".join(
            f"{r.series_id}: {r.days} day(s) of history, {first + horizon} required"
            for r in named))
    shared = settled(fold_histories(series, horizon, first, step, targets))
    scored = (evaluate(method_folds(shared, tried, horizon)) if evaluations is None
              else evaluations.evaluate(shared, tried, horizon))
    return with_short_series(scored, short, targets)
