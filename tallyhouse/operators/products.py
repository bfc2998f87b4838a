"""Product-level measures at (name, variation) grain.

Lines are first reduced to one row per (order, product). That reduction rides on the
shuffle the order join already made, turns the distinct order count into a plain sum, and
is the same relation baskets start from. Catalogue names join after the product aggregate,
so text never travels with the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import clock, money, ratios
from tallyhouse.functions.clock import Period
from tallyhouse.operators import calendar
from tallyhouse.schemas import DEFAULT_KINDS

SORTS = {
    "net_sales": "net_sales_pence",
    "gross_sales": "gross_sales_pence",
    "net_units": "net_units",
    "discounts": "discounts_pence",
}
IDENTITY = ("product_id", "product_name", "product_variation", "kind")


def lines_in_period(orders: DataFrame, items: DataFrame, period: Period) -> DataFrame:
    """Lines of the period's orders with the order's instant and event."""
    windowed = period.orders(orders)
    # Lines carry no instant; the month partition keeps the scan to the period.
    lines = period.stored(items).select(
        "order_id", "product_id", "quantity", "line_total", "discount_amount")
    return lines.join(windowed.select("order_id", "occurred_at", "event_type"), "order_id")


def order_products(lines: DataFrame) -> DataFrame:
    """One row per (order, product) with that product's sums on the order."""
    return lines.groupBy("order_id", "product_id", "occurred_at", "event_type").agg(
        F.sum("line_total").alias("gross"),
        F.sum("discount_amount").alias("discount"),
        F.sum("quantity").alias("units"),
    )


def _line_measures(inside: Column | None = None, prefix: str = "") -> list[Column]:
    scope = F.lit(True) if inside is None else inside

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(scope, value)), F.lit(0)).cast("bigint")

    paid = F.when(scope & (F.col("event_type") == "payment"), F.lit(1))
    return [
        total(F.col("gross")).alias(prefix + "gross_sales_pence"),
        total(F.col("discount")).alias(prefix + "discounts_pence"),
        total(F.col("gross") - F.col("discount")).alias(prefix + "net_sales_pence"),
        total(F.col("units")).alias(prefix + "net_units"),
        F.count(paid).alias(prefix + "payment_order_count"),
    ]


def _named(per_product: DataFrame, products: DataFrame, kinds: Sequence[str]) -> DataFrame:
    names = products.filter(F.col("kind").isin(list(kinds))).select(
        "product_id", F.col("name").alias("product_name"),
        F.col("variation").alias("product_variation"), "kind",
    )
    measures = [c for c in per_product.columns if c != "product_id"]
    return per_product.join(names, "product_id").select(*IDENTITY, *measures)


def product_totals(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    kinds: Sequence[str] = DEFAULT_KINDS,
) -> DataFrame:
    """One row per product variation sold or refunded in the period."""
    pairs = order_products(lines_in_period(orders, items, period))
    return _named(pairs.groupBy("product_id").agg(*_line_measures()), products, kinds)


def two_period_totals(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    kinds: Sequence[str] = DEFAULT_KINDS,
) -> DataFrame:
    """Totals of the period and, prefixed ``previous_``, of the one before, in one scan.

    ``in_period`` and ``in_previous`` say in which of them the product had any line.
    """
    before = period.previous()
    at = F.col("occurred_at")
    now_, then_ = period.contains(at), before.contains(at)
    pairs = order_products(lines_in_period(orders, items, before.through(period)))
    merged = pairs.groupBy("product_id").agg(
        *_line_measures(now_), *_line_measures(then_, "previous_"),
        F.max(now_).alias("in_period"), F.max(then_).alias("in_previous"),
    )
    return _named(merged, products, kinds)


def whole_of(totals: DataFrame, *columns: str) -> Column:
    """Sums over every row of an aggregated frame, as one scalar struct.

    A scalar subquery rather than an unpartitioned window, which would move every product
    into one task. The sums cover all measures, not just the ones asked for, so the
    subquery's plan equals the outer one up to the shuffle and that shuffle is reused.
    """
    sums = [F.sum(c).alias(c) for c in columns]
    return totals.agg(F.struct(*sums).alias("whole")).scalar()


MEASURES = (
    "gross_sales_pence", "discounts_pence", "net_sales_pence", "net_units",
    "payment_order_count",
)


def product_performance(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    sort: str = "net_sales", kinds: Sequence[str] = DEFAULT_KINDS, limit: int | None = None,
) -> DataFrame:
    """Ranked variations with shares of everything that matched, taken before the limit."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {sorted(SORTS)}, got {sort!r}")
    totals = product_totals(orders, items, products, period, kinds)
    whole = whole_of(totals, *MEASURES)
    ranked = totals.select(
        *IDENTITY, *MEASURES,
        money.selling_price(F.col("net_sales_pence"), F.col("net_units"))
        .alias("average_selling_price_pence"),
        ratios.percent(F.col("net_sales_pence"), whole["net_sales_pence"])
        .alias("share_of_net_sales_percent"),
        ratios.percent(F.col("net_units"), whole["net_units"])
        .alias("share_of_units_percent"),
    ).orderBy(F.desc(SORTS[sort]), "product_name", "product_variation", "product_id")
    return ranked if limit is None else ranked.limit(limit)


def performance_totals(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    kinds: Sequence[str] = DEFAULT_KINDS,
) -> DataFrame:
    """Net sales and units over every matching product: the denominators of the shares."""
    totals = product_totals(orders, items, products, period, kinds)
    return totals.agg(
        F.coalesce(F.sum("net_sales_pence"), F.lit(0)).cast("bigint")
        .alias("total_net_sales_pence"),
        F.coalesce(F.sum("net_units"), F.lit(0)).cast("bigint").alias("total_net_units"),
    )


def product_movers(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    kinds: Sequence[str] = DEFAULT_KINDS, limit: int | None = None,
) -> DataFrame:
    """Every product of either period, largest absolute change in net sales first."""
    both = two_period_totals(orders, items, products, period, kinds)
    now, then = F.col("net_sales_pence"), F.col("previous_net_sales_pence")
    moved = both.select(
        *IDENTITY,
        now.alias("current_net_sales_pence"), "previous_net_sales_pence",
        (now - then).alias("net_sales_change_pence"),
        ratios.percent_change(now, then).alias("net_sales_percent_change"),
        F.col("net_units").alias("current_net_units"), "previous_net_units",
        (F.col("net_units") - F.col("previous_net_units")).alias("net_units_change"),
        ratios.movement_status(now, then).alias("movement_status"),
    ).orderBy(
        F.desc(F.abs(F.col("net_sales_change_pence"))),
        "product_name", "product_variation", "product_id",
    )
    return moved if limit is None else moved.limit(limit)


def product_trend(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    product_id: int, granularity: str = "day",
) -> DataFrame | None:
    """Zero-filled series of one product; None when the catalogue does not hold it."""
    if products.filter(F.col("product_id") == product_id).isEmpty():
        return None
    one = items.filter(F.col("product_id") == product_id)
    start = clock.bucket(F.col("occurred_at"), period.zone, granularity)
    found = (
        order_products(lines_in_period(orders, one, period))
        .groupBy(start.alias("period_start")).agg(*_line_measures())
    )
    buckets = calendar.scaffold(orders.sparkSession, period, granularity)
    return calendar.fill_gaps(found, buckets, ["period_start"]).orderBy("period_start")


def product_trends(
    orders: DataFrame, items: DataFrame, period: Period, granularity: str = "week",
) -> DataFrame:
    """The series of every product that traded in the period, zero-filled, in one job."""
    start = clock.bucket(F.col("occurred_at"), period.zone, granularity)
    found = (
        order_products(lines_in_period(orders, items, period))
        .groupBy("product_id", start.alias("period_start")).agg(*_line_measures())
    )
    first, last = F.lit(period.start), F.lit(period.end)
    step = F.expr("INTERVAL 1 DAY" if granularity == "day" else "INTERVAL 7 DAYS")
    if granularity == "week":
        first = clock.week_of(first)
    # Each row gives the empty periods up to the product's next one, the first row also those
    # before it, so only periods with trade are ever shuffled and the calendar never joins.
    ahead = Window.partitionBy("product_id").orderBy("period_start")
    start, until = F.col("period_start"), F.col("until")
    spans = found.withColumn("until", F.lead("period_start").over(ahead)).withColumn(
        "since", F.when(F.lag("until").over(ahead).isNull(), first).otherwise(start))
    filled = spans.withColumn("at", F.explode(F.filter(
        F.sequence("since", F.coalesce(until, last), step),
        lambda day: until.isNull() | (day < until))))
    return filled.select(
        "product_id", F.col("at").alias("period_start"),
        *[F.when(F.col("at") == start, F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c)
          for c in MEASURES])


def trend_totals(trend: DataFrame) -> DataFrame:
    """A product's series added up; an order falls in one bucket, so counts add too."""
    sums = trend.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                       for c in MEASURES])
    return sums.select("*", money.selling_price(F.col("net_sales_pence"), F.col("net_units"))
                       .alias("average_selling_price_pence"))


def find_product(products: DataFrame, product_id: int) -> DataFrame:
    return products.filter(F.col("product_id") == product_id).limit(1)
