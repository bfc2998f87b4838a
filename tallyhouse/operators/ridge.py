"""Ridge forecasts by recursion, for many training cuts of many series at once.

Spark holds the series, spreads them over tasks, scores the paths and picks the penalty;
the function below only fits small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.features import LAGS, MIN_HISTORY
from tallyhouse.session import ship

# Penalty grid, inner validation blocks, targets that cannot go below zero.
ALPHAS = (0.1, 1.0, 10.0, 100.0)
INNER_BLOCKS = 3
FLOORED = ("payment_order_count", "net_units")

PATHS_SCHEMA = (
    "series_id string, target string, cut int, alpha double, is_origin boolean,"
    " forecast array<double>, actual array<double>"
)


def calendar_flags(days: np.ndarray, months: bool, holidays: bool) -> np.ndarray:
    """0/1 columns for an array of dates: weekday (Monday base), months, fixed holidays."""
    weekday = (days.astype(int) + 3) % 7
    flags = [(weekday == d) for d in range(1, 7)]
    month = days.astype("datetime64[M]").astype(int) % 12 + 1
    if months:
        flags += [(month == m) for m in range(2, 13)]
    if holidays:
        of_month = (days - days.astype("datetime64[M]")).astype(int) + 1
        flags.append(((month == 12) & np.isin(of_month, (25, 26)))
                     | ((month == 1) & (of_month == 1)))
    return np.column_stack(flags).astype(float)


def trailing_levels(trailing: np.ndarray) -> np.ndarray:
    """Lags and trailing means from the last 28 values of each row."""
    lags = [trailing[:, -k] for k in LAGS]
    return np.column_stack([*lags, trailing[:, -7:].mean(axis=1), trailing.mean(axis=1)])


def _fit(levels: np.ndarray, flags: np.ndarray, y: np.ndarray, alphas) -> tuple:
    """Coefficients per penalty; levels are standardised, flags are not, intercept is free."""
    centre, spread = levels.mean(axis=0), levels.std(axis=0)
    spread = np.where(spread <= np.abs(centre) * 1e-12, 1.0, spread)
    x = np.hstack([(levels - centre) / spread, flags])
    middle, level = x.mean(axis=0), y.mean()
    x = x - middle
    gram, moment = x.T @ x, x.T @ (y - level)
    ridge = np.eye(x.shape[1])
    weights = np.array([np.linalg.solve(gram + a * ridge, moment) for a in alphas])
    return centre, spread, weights, level - weights @ middle


def ridge_paths(values: np.ndarray, first_day, cut: int, horizon: int, floor: bool,
                alphas, months: bool, holidays: bool) -> np.ndarray:
    """(alphas, horizon) forecasts after ``values[:cut]``, each step fed its own predictions."""
    start = np.datetime64(first_day, "D")
    known = values[:cut]
    windows = np.lib.stride_tricks.sliding_window_view(known, MIN_HISTORY)[:-1]
    trained = start + np.arange(MIN_HISTORY, cut)
    centre, spread, weights, intercept = _fit(
        trailing_levels(windows), calendar_flags(trained, months, holidays),
        known[MIN_HISTORY:], alphas)
    ahead = calendar_flags(start + np.arange(cut, cut + horizon), months, holidays)
    trailing = np.tile(known[-MIN_HISTORY:], (len(alphas), 1))
    path = np.empty((len(alphas), horizon))
    for step in range(horizon):
        x = np.hstack([(trailing_levels(trailing) - centre) / spread,
                       np.tile(ahead[step], (len(alphas), 1))])
        predicted = (x * weights).sum(axis=1) + intercept
        path[:, step] = np.maximum(predicted, 0.0) if floor else predicted
        trailing = np.hstack([trailing[:, 1:], path[:, step:step + 1]])
    return path


def forecast_paths(
    histories: DataFrame, horizon: int, alphas: tuple[float, ...] = ALPHAS,
    include_month: bool = False, include_holiday: bool = True, tasks: int | None = None,
) -> DataFrame:
    """Forecast paths for the cuts each row asks for, under every penalty.

    ``histories`` has ``series_id, target, first_day, values`` and ``origins``, the training
    lengths to forecast from. The inner validation cuts before each origin are added; cuts
    that several origins share are fitted once. Rows are spread with a fixed task count,
    because the work is in the fitting and not in the bytes adaptive execution goes by.
    """
    back = F.sequence(F.lit(0), F.lit(INNER_BLOCKS))
    wanted = F.array_distinct(F.flatten(F.transform(
        "origins", lambda o: F.transform(back, lambda k: o - k * horizon))))
    # An inner cut needs a design row and a horizon beyond the 28 days of pure history.
    cuts = F.filter(wanted, lambda c: (c > MIN_HISTORY + horizon)
                    | F.array_contains("origins", c))
    rows = histories.select("series_id", "target", "first_day", "values", "origins",
                            F.array_sort(cuts).alias("cuts"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = []
                values, origins = np.asarray(row.values, dtype=float), set(row.origins)
                floor = row.target in FLOORED
                for cut in row.cuts:
                    path = ridge_paths(values, row.first_day, int(cut), horizon, floor,
                                       alphas, include_month, include_holiday)
                    held_out = values[cut:cut + horizon]
                    out += [(row.series_id, row.target, int(cut), alpha, cut in origins,
                             path[i], held_out) for i, alpha in enumerate(alphas)]
                yield pd.DataFrame(out, columns=[
                    "series_id", "target", "cut", "alpha", "is_origin", "forecast", "actual"])

    spark = ship(histories.sparkSession)
    count = tasks or max(spark.sparkContext.defaultParallelism,
                         int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(count, "series_id", "target").mapInPandas(fit, PATHS_SCHEMA)


def absolute_error(actual, forecast):
    """Sum of |actual - forecast| over two aligned array columns."""
    gaps = F.zip_with(actual, forecast, lambda a, f: F.abs(a - f))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, v: acc + v)


def selected_paths(paths: DataFrame, horizon: int) -> DataFrame:
    """One path per origin, under the penalty that did best on its inner cuts.

    Inner cuts lie one to three horizons before the origin, so their held-out days are all
    inside the training window. Equal errors go to the larger penalty, and so does an origin
    with too little history to validate on.

    Every path plays its roles at once (forecast of its own cut, validation of the three
    origins after it), so the fitted paths are read in a single pass.
    """
    error = F.when(
        (F.col("cut") > MIN_HISTORY + horizon) & (F.size("actual") == horizon),
        absolute_error(F.col("actual"), F.col("forecast")),
    )
    path = F.when(F.col("is_origin"), F.struct("forecast", "actual"))
    roles = [F.struct(F.col("cut").alias("origin"), path.alias("path"),
                      F.lit(None).cast("double").alias("error"))]
    roles += [F.struct((F.col("cut") + k * horizon).alias("origin"),
                       F.when(F.lit(False), path).alias("path"), error.alias("error"))
              for k in range(1, INNER_BLOCKS + 1)]
    tried = paths.select("series_id", "target", "alpha", F.inline(F.array(*roles))).groupBy(
        "series_id", "target", "origin", "alpha"
    ).agg(F.first("path", ignorenulls=True).alias("path"), F.avg("error").alias("error"))
    rank = F.struct(F.coalesce("error", F.lit(0.0)), -F.col("alpha"))
    return tried.filter(F.col("path").isNotNull()).groupBy("series_id", "target", "origin").agg(
        F.min_by(F.struct("alpha", "path.*"), rank).alias("best")
    ).select("series_id", "target", "origin", "best.*")
