"""Forecast methods by name, all evaluated on the same folds.

A method is given the series' histories with the training lengths of their folds, and answers
with a forecast for each. Those that are one column expression of the training values are
evaluated together in a single pass; fitted ones bring a function over the histories.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.baselines import BASELINES
from tallyhouse.operators.features import MIN_HISTORY
from tallyhouse.operators.ridge import forecast_paths, selected_paths
from tallyhouse.operators.trees import boosted_paths

FOLD_COLUMNS = ("series_id", "target", "origin", "method", "forecast", "actual")
# A fitted method trains on rows beyond the 28 days of pure history: a fortnight of them.
FITTED_HISTORY = MIN_HISTORY + 14


@dataclass(frozen=True)
class Method:
    """One of ``expression(history, horizon)`` and ``paths(histories, horizon)``.

    ``paths`` returns ``series_id, target, origin, forecast, actual`` for the ``origins`` of
    each row of ``series_id, target, first_day, values, origins``, and may use no value at or
    after an origin for its forecast. Whoever changes what a name computes raises its
    ``version``, by which stored evaluations are told apart.
    """

    name: str
    min_history: int
    expression: Callable[[Column, int], Column] | None = None
    paths: Callable[[DataFrame, int], DataFrame] | None = None
    version: int = 1

    def __post_init__(self):
        if (self.expression is None) == (self.paths is None):
            raise ValueError(f"{self.name} needs either an expression or paths")


def ridge_method(include_month: bool = False, include_holiday: bool = True) -> Method:
    """Ridge with the penalty chosen inside each training window."""
    def paths(histories: DataFrame, horizon: int) -> DataFrame:
        tried = forecast_paths(histories, horizon, include_month=include_month,
                               include_holiday=include_holiday)
        return selected_paths(tried, horizon).drop("alpha")

    name = "ridge" + ("_month" if include_month else "") + ("_holiday" if include_holiday else "")
    return Method(name, FITTED_HISTORY, paths=paths)


METHODS: dict[str, Method] = {}


def register(method: Method) -> Method:
    """Makes a method known by its name; a name is given once."""
    if method.name in METHODS:
        raise ValueError(f"method {method.name} is registered already")
    METHODS[method.name] = method
    return method


for _name, (_expression, _days) in BASELINES.items():
    register(Method(_name, _days, expression=_expression))
for _month in (False, True):
    for _holiday in (False, True):
        register(ridge_method(_month, _holiday))
register(Method("gradient_boosting", FITTED_HISTORY, paths=boosted_paths))


def chosen(methods: Sequence[str | Method]) -> list[Method]:
    """Methods by name or as they are; an unknown or repeated name raises."""
    unknown = [m for m in methods if isinstance(m, str) and m not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known: {sorted(METHODS)}")
    found = [METHODS[m] if isinstance(m, str) else m for m in methods]
    names = [m.name for m in found]
    if not names or len(set(names)) < len(names):
        raise ValueError(f"methods must be distinct and at least one, got {names}")
    return found


def method_folds(histories: DataFrame, methods: Sequence[Method], horizon: int) -> DataFrame:
    """`FOLD_COLUMNS` of every method on every origin of the histories."""
    parts = []
    simple = [m for m in methods if m.expression is not None]
    if simple:
        split = histories.select(
            "series_id", "target", "values", F.explode("origins").alias("origin")
        ).select(
            "series_id", "target", "origin",
            F.slice("values", F.lit(1), F.col("origin")).alias("history"),
            F.slice("values", F.col("origin") + 1, F.lit(horizon)).alias("actual"))
        tried = F.array(*[
            F.struct(F.lit(m.name).alias("method"),
                     m.expression(F.col("history"), horizon).alias("forecast")) for m in simple])
        parts.append(split.select("*", F.inline(tried)).select(*FOLD_COLUMNS))
    for method in methods:
        if method.paths is not None:
            parts.append(method.paths(histories, horizon).withColumn(
                "method", F.lit(method.name)).select(*FOLD_COLUMNS))
    return reduce(DataFrame.unionByName, parts)
