"""Everything measurable about one product in one row: totals, movement, best partner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import money, ratios
from tallyhouse.functions.clock import Period
from tallyhouse.operators import baskets as basket_ops
from tallyhouse.operators.products import (
    IDENTITY, MEASURES, performance_totals, two_period_totals, whole_of,
)
from tallyhouse.schemas import DEFAULT_KINDS

# Sortable columns of the evidence table.
COLUMNS = {
    "product": None,
    "net_sales": "net_sales_pence",
    "net_units": "net_units",
    "payment_orders": "payment_order_count",
    "average_price": "average_selling_price_pence",
    "share": "share_of_menu_net_sales_percent",
    "discounts": "discounts_pence",
    "discount_rate": "discount_rate_percent",
    "movement": "net_sales_change_pence",
}


def menu_evidence(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    min_pair_orders: int = 5, kinds: Sequence[str] = DEFAULT_KINDS, limit: int | None = None,
) -> DataFrame:
    """One row per product with a line in the period, richest first.

    Two passes over the lines: one for both periods' sums, one narrow pass (two ids) for
    baskets. Sharing a single wide pass would have to park it on disk and read it twice,
    which moves as many bytes.
    """
    both = two_period_totals(orders, items, products, period, kinds)
    current = both.filter("in_period")
    whole = whole_of(current, *[c for c in current.columns
                                if c in MEASURES or c.startswith("previous_")])
    merged = basket_ops.baskets_of(
        basket_ops.basket_lines(orders, items, products, period, kinds))
    best = basket_ops.strongest_attachments(merged, products, min_pair_orders)

    now, then = F.col("net_sales_pence"), F.col("previous_net_sales_pence")
    rows = current.join(best, "product_id", "left").select(
        *IDENTITY, *MEASURES,
        money.selling_price(now, F.col("net_units")).alias("average_selling_price_pence"),
        ratios.percent(F.col("discounts_pence"), F.col("gross_sales_pence"), 4)
        .alias("discount_rate_percent"),
        ratios.percent(now, whole["net_sales_pence"], 4)
        .alias("share_of_menu_net_sales_percent"),
        ratios.percent(F.col("net_units"), whole["net_units"], 4)
        .alias("share_of_menu_units_percent"),
        "previous_net_sales_pence", "previous_net_units",
        (now - then).alias("net_sales_change_pence"),
        (F.col("net_units") - F.col("previous_net_units")).alias("net_units_change"),
        ratios.percent_change(now, then).alias("net_sales_percent_change"),
        ratios.movement_status(now, then).alias("movement_status"),
        ratios.revenue_direction(now - then).alias("revenue_direction"),
        "attachment_product_id", "attachment_product_name", "attachment_product_variation",
        "attachment_pair_orders", "attachment_rate_percent", "attachment_lift",
    ).orderBy(F.desc("net_sales_pence"), "product_name", "product_variation", "product_id")
    return rows if limit is None else rows.limit(limit)


def evidence_totals(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    kinds: Sequence[str] = DEFAULT_KINDS,
) -> DataFrame:
    """What the evidence rows are a breakdown of: net sales, units and eligible orders."""
    merged = basket_ops.baskets_of(
        basket_ops.basket_lines(orders, items, products, period, kinds))
    return performance_totals(orders, items, products, period, kinds).withColumn(
        "eligible_order_count", merged.eligible_orders().scalar())


def sort_evidence(rows: DataFrame, column: str, direction: str | None = None) -> DataFrame:
    """Order by any table column; undefined values come last in both directions."""
    if column not in COLUMNS:
        raise ValueError(f"column must be one of {sorted(COLUMNS)}, got {column!r}")
    direction = direction or ("asc" if column == "product" else "desc")
    if direction not in ("asc", "desc"):
        raise ValueError(f"direction must be 'asc' or 'desc', got {direction!r}")
    key = (
        F.lower(F.concat_ws(" ", "product_name", "product_variation"))
        if column == "product" else F.col(COLUMNS[column])
    )
    first = key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()
    return rows.orderBy(first, "product_name", "product_variation", "product_id")


def leading_products(rows: DataFrame) -> DataFrame:
    """One row: the product leading by net sales and the one leading by units.

    Ties go to the earlier name, the order the ranking shows.
    """
    tie = [F.col("product_name"), F.col("product_variation"), F.col("product_id")]
    whole = F.struct(*IDENTITY, "net_sales_pence", "net_units")

    # min_by on the negated measure lets the same struct prefer the earlier name.
    def leader(measure: str):
        return F.min_by(whole, F.struct((-F.col(measure)).alias("m"), *tie))

    led = rows.agg(
        F.count(F.lit(1)).alias("variation_count"),
        leader("net_sales_pence").alias("s"), leader("net_units").alias("u"),
    )
    return led.select(
        "variation_count",
        F.col("s.product_id").alias("sales_product_id"),
        F.col("s.product_name").alias("sales_product_name"),
        F.col("s.product_variation").alias("sales_product_variation"),
        F.col("s.net_sales_pence").alias("leading_net_sales_pence"),
        F.col("u.product_id").alias("units_product_id"),
        F.col("u.product_name").alias("units_product_name"),
        F.col("u.product_variation").alias("units_product_variation"),
        F.col("u.net_units").alias("leading_net_units"),
    )
