"""Order-level measures: headline totals, series, weekday and hour profiles, channel mix.

Money sums span every event, so refunds reduce them; counts look at payments only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import clock, money, ratios
from tallyhouse.functions.clock import Period
from tallyhouse.operators import calendar

SERIES_MEASURES = (
    "net_sales_pence", "gross_sales_pence", "discounts_pence",
    "payment_order_count", "net_units",
)


def measures(inside: Column | None = None, prefix: str = "") -> list[Column]:
    """The six shared aggregates, optionally only over rows where ``inside`` holds."""
    scope = F.lit(True) if inside is None else inside

    def total(column: str) -> Column:
        kept = F.when(scope, F.col(column))
        return F.coalesce(F.sum(kept), F.lit(0)).cast("bigint")

    def events(kind: str) -> Column:
        return F.count(F.when(scope & (F.col("event_type") == kind), F.lit(1)))

    return [
        total("net_amount").alias(prefix + "net_sales_pence"),
        total("gross_amount").alias(prefix + "gross_sales_pence"),
        total("discount_amount").alias(prefix + "discounts_pence"),
        events("payment").alias(prefix + "payment_order_count"),
        events("refund").alias(prefix + "refund_event_count"),
        total("item_count").alias(prefix + "net_units"),
    ]


def _average_order(prefix: str = "") -> Column:
    return money.mean_pence(
        F.col(prefix + "net_sales_pence"), F.col(prefix + "payment_order_count")
    ).alias(prefix + "average_order_value_pence")


def overview(orders: DataFrame, period: Period, compare: bool = False) -> DataFrame:
    """One row of headline totals, with the previous period beside it when ``compare``.

    Both periods come from one scan through conditional aggregates.
    """
    if not compare:
        totals = period.orders(orders).agg(*measures())
        return totals.select("*", _average_order())

    before = period.previous()
    both = before.through(period).orders(orders)
    totals = both.agg(
        *measures(period.contains(F.col("occurred_at"))),
        *measures(before.contains(F.col("occurred_at")), "previous_"),
    ).select("*", _average_order(), _average_order("previous_"))

    now, then = F.col("net_sales_pence"), F.col("previous_net_sales_pence")
    return totals.select(
        "net_sales_pence", "gross_sales_pence", "discounts_pence", "payment_order_count",
        "refund_event_count", "net_units", "average_order_value_pence",
        "previous_net_sales_pence", "previous_payment_order_count", "previous_net_units",
        "previous_average_order_value_pence",
        (now - then).alias("net_sales_change_pence"),
        ratios.percent_change(now, then).alias("net_sales_percent_change"),
        (F.col("payment_order_count") - F.col("previous_payment_order_count"))
        .alias("payment_order_count_change"),
        (F.col("net_units") - F.col("previous_net_units")).alias("net_units_change"),
        ratios.movement_status(now, then).alias("comparison_status"),
    )


def revenue_series(orders: DataFrame, period: Period, granularity: str = "day") -> DataFrame:
    """Local day or week totals; buckets without trade are zero rows."""
    start = clock.bucket(F.col("occurred_at"), period.zone, granularity)
    found = (
        period.orders(orders)
        .groupBy(start.alias("period_start")).agg(*measures())
        .drop("refund_event_count")
    )
    buckets = calendar.scaffold(orders.sparkSession, period, granularity)
    return calendar.fill_gaps(found, buckets, ["period_start"]).orderBy("period_start")


def day_of_week(orders: DataFrame, period: Period) -> DataFrame:
    """Seven rows, Monday first."""
    day = clock.iso_weekday(F.col("occurred_at"), period.zone)
    found = (
        period.orders(orders)
        .groupBy(day.alias("iso_weekday")).agg(*measures())
    )
    filled = calendar.fill_gaps(
        found, calendar.weekday_scaffold(orders.sparkSession), ["iso_weekday"]
    )
    return filled.select(
        "iso_weekday", clock.weekday_name(F.col("iso_weekday")).alias("weekday"),
        "net_sales_pence", "payment_order_count", "net_units", _average_order(),
    ).orderBy("iso_weekday")


def peak_hours(orders: DataFrame, period: Period) -> DataFrame:
    """The full 7 x 24 grid of local trading hours."""
    at = F.col("occurred_at")
    found = (
        orders.filter(period.contains(at))
        .groupBy(clock.iso_weekday(at, period.zone).alias("iso_weekday"),
                 clock.local_hour(at, period.zone).alias("hour"))
        .agg(*measures())
    )
    filled = calendar.fill_gaps(
        found, calendar.hour_grid(orders.sparkSession), ["iso_weekday", "hour"]
    )
    return filled.select(
        "iso_weekday", clock.weekday_name(F.col("iso_weekday")).alias("weekday"), "hour",
        "payment_order_count", "net_sales_pence", "net_units",
    ).orderBy("iso_weekday", "hour")


def busiest_hours(grid: DataFrame, limit: int = 5) -> DataFrame:
    """The cells with the most payment orders, earliest first among equals."""
    return (
        grid.filter(F.col("payment_order_count") > 0)
        .orderBy(F.desc("payment_order_count"), "iso_weekday", "hour").limit(limit)
    )


def hour_totals(grid: DataFrame) -> DataFrame:
    """Peak cell and number of cells that traded."""
    orders = F.col("payment_order_count")
    return grid.agg(
        F.coalesce(F.max(orders), F.lit(0)).cast("bigint").alias("peak_payment_order_count"),
        F.count(F.when(orders > 0, F.lit(1))).alias("trading_hour_cell_count"),
    )


def hour_matrix(grid: DataFrame) -> DataFrame:
    """One row per weekday with a payment-order column ``h0`` … ``h23`` per hour."""
    cells = [
        F.coalesce(F.max(F.when(F.col("hour") == h, F.col("payment_order_count"))), F.lit(0))
        .cast("bigint").alias(f"h{h}")
        for h in range(24)
    ]
    return grid.groupBy("iso_weekday").agg(*cells).orderBy("iso_weekday")


def hour_intensity(grid: DataFrame, steps: int = 4) -> DataFrame:
    """Grid with an ``intensity`` of 0 for no trade, then 1 … ``steps`` relative to the peak."""
    peak = grid.agg(F.max("payment_order_count").alias("peak")).scalar()
    count = F.col("payment_order_count")
    scaled = F.ceil(count.cast("double") / peak.cast("double") * steps)
    step = F.when((count <= 0) | (peak <= 0), F.lit(0)).otherwise(
        F.least(F.greatest(scaled, F.lit(1)), F.lit(steps))
    )
    return grid.withColumn("intensity", step.cast("int"))


def channel_mix(orders: DataFrame, period: Period) -> DataFrame:
    """Channels richest first with their shares of payment orders and of net sales."""
    totals = (
        period.orders(orders)
        .groupBy("channel").agg(*measures())
    )
    whole = totals.agg(F.struct(
        *[F.sum(c).alias(c) for c in totals.columns if c != "channel"]).alias("whole")).scalar()
    return totals.select(
        "channel", "net_sales_pence", "payment_order_count", "net_units", _average_order(),
        ratios.percent(F.col("payment_order_count"), whole["payment_order_count"])
        .alias("share_of_payment_orders_percent"),
        ratios.percent(F.col("net_sales_pence"), whole["net_sales_pence"])
        .alias("share_of_net_sales_percent"),
    ).orderBy(F.desc("net_sales_pence"), "channel")


def observed_range(orders: DataFrame, zone: str) -> DataFrame:
    """First and last local day that holds an order.

    The extremes are taken on the raw instants, where the scan's statistics can answer.
    """
    ends = orders.agg(F.min("occurred_at").alias("lo"), F.max("occurred_at").alias("hi"))
    return ends.select(
        clock.local_day(F.col("lo"), zone).alias("first_day"),
        clock.local_day(F.col("hi"), zone).alias("last_day"),
    )


def series_totals(series: DataFrame) -> DataFrame:
    """Sums over a bucketed series, for reconciling it with the overview."""
    return series.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                        for c in ("net_sales_pence", "payment_order_count", "net_units")])


def peak_net_sales(frame: DataFrame) -> DataFrame:
    """Largest net sales among weekdays or channels; never below 0."""
    return frame.agg(
        F.greatest(F.coalesce(F.max("net_sales_pence"), F.lit(0)), F.lit(0))
        .cast("bigint").alias("peak_net_sales_pence")
    )
