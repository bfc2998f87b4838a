"""Daily series for forecasting: one row per series and local day, zeros included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import clock
from tallyhouse.operators.orders import measures
from tallyhouse.schemas import DEFAULT_ZONE

TARGETS = ("net_sales_pence", "payment_order_count", "net_units")
TRAINING_DAYS = 365


class SeriesIntegrityError(ValueError):
    """A series is not fit to train on. Raised, never repaired."""


def daily_series(
    orders: DataFrame, zone: str = DEFAULT_ZONE, series: str | None = None,
    training_days: int | None = TRAINING_DAYS,
) -> DataFrame:
    """``series_id, day`` and the three targets, for the latest days each series observed.

    A series ends on the last day it holds an order and reaches back ``training_days`` (all
    of its days for None), never before its first. ``series`` names the key column; without
    it everything is one series.
    """
    key = F.col(series).cast("string") if series else F.lit("all")
    found = orders.groupBy(
        key.alias("series_id"), clock.local_day(F.col("occurred_at"), zone).alias("day")
    ).agg(*measures()).select("series_id", "day", *TARGETS)
    return filled_series(found, training_days)


def filled_series(found: DataFrame, training_days: int | None = TRAINING_DAYS) -> DataFrame:
    """`daily_series` of days that are added up already, one row per series and observed day."""
    # A series is at most one row per day by now. Each observed day also emits the quiet
    # days up to the next one, so no calendar is joined.
    per_series = Window.partitionBy("series_id")
    until = F.date_sub(F.lead("day").over(per_series.orderBy("day")), 1)
    spread = found.select(
        "series_id", "day", *TARGETS, F.max("day").over(per_series).alias("last"),
        F.coalesce(until, F.col("day")).alias("until"),
    )
    filled = spread.select(
        "series_id", "last", F.explode(F.sequence("day", "until")).alias("on"), "day", *TARGETS)
    if training_days is not None:
        filled = filled.filter(F.datediff("last", "on") < training_days)
    return filled.select(
        "series_id", F.col("on").alias("day"),
        *[F.when(F.col("on") == F.col("day"), F.col(t)).otherwise(F.lit(0)).cast("bigint")
          .alias(t) for t in TARGETS],
    )


def traded() -> Column:
    """Whether anything happened on the day; refunds may cancel sales to a zero total."""
    any_measure = F.lit(False)
    for target in TARGETS:
        any_measure = any_measure | (F.col(target) != 0)
    return any_measure


def series_violations(series: DataFrame, minimum_days: int = 1) -> DataFrame:
    """``series_id, day, problem`` for everything that makes a series unusable.

    Checks the rows against each other by day, so rows may arrive in any order.
    """
    in_order = Window.partitionBy("series_id").orderBy("day")
    step = F.datediff("day", F.lag("day").over(in_order))
    checked = series.withColumn("step", step)
    missing = F.lit(False)
    for target in TARGETS:
        missing = missing | F.col(target).isNull()
    problems = F.filter(
        F.array(
            F.when(F.col("step") == 0, F.lit("duplicate date")),
            F.when(F.col("step") > 1,
                   F.concat(F.col("step") - 1, F.lit("-day gap before this day"))),
            F.when(missing, F.lit("missing value")),
            F.when(F.col("payment_order_count") < 0, F.lit("negative order count")),
        ),
        lambda p: p.isNotNull(),
    )
    per_row = checked.select("series_id", "day", F.explode(problems).alias("problem"))
    short = (
        series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("day"))
        .filter(F.col("n") < minimum_days)
        .select("series_id", "day", F.concat(
            F.lit("only "), F.col("n"), F.lit(f" day(s), {minimum_days} required")
        ).alias("problem"))
    )
    return per_row.unionByName(short)


def validate_series(series: DataFrame, minimum_days: int = 1) -> DataFrame:
    """The series itself, or an error naming the first few violations."""
    found = series_violations(series, minimum_days).orderBy("series_id", "day").take(5)
    if found:
        raise SeriesIntegrityError(
            "; ".join(f"{r.series_id} {r.day}: {r.problem}" for r in found))
    if series.isEmpty():
        raise SeriesIntegrityError("series is empty")
    return series


def by_target(series: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """Long form: ``series_id, target, day, value``."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("value"))
                      for t in targets])
    return series.select("series_id", "day", F.explode(pairs).alias("p")).select(
        "series_id", "p.target", "day", "p.value")


def histories(series: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """One row per series and target: first day and all values in day order.

    The arrays hold one number per calendar day, so their size is bounded by the training
    window and not by the number of orders.
    """
    pairs = F.sort_array(F.collect_list(F.struct("day", *targets)))
    packed = series.groupBy("series_id").agg(pairs.alias("days"))
    values = [F.struct(F.lit(t).alias("target"),
                       F.col("days").getField(t).cast("array<double>").alias("values"))
              for t in targets]
    unpacked = packed.select(
        "series_id", F.col("days")[0]["day"].alias("first_day"), F.inline(F.array(*values)))
    return unpacked.select("series_id", "target", "first_day", "values")


def forecast_days(series: DataFrame, horizon: int) -> DataFrame:
    """The ``horizon`` days after each series' last one, with their step."""
    if horizon < 1:
        raise ValueError(f"horizon must be at least 1, got {horizon}")
    last = series.groupBy("series_id").agg(F.max("day").alias("last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return last.select("series_id", "last", steps.alias("step")).select(
        "series_id", "step", F.date_add("last", F.col("step")).alias("day"))
