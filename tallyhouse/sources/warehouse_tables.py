"""Analytic tables bridged from a star-schema parquet folder (orders, lineitem, part, …).

Gives every operator real inputs without an import: prices become whole pence once, here,
and order totals are the sums of their lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How the folder's codes map to the stored vocabularies.
CHANNEL_BY_PRIORITY = {
    "1-URGENT": "delivery",
    "2-HIGH": "online",
    "3-MEDIUM": "in_store",
    "4-NOT SPECIFIED": "mixed",
    "5-LOW": "collection",
}
REFUND_STATUS = "P"
VOUCHER_TYPE, OPEN_PRICE_TYPE = "PROMO", "ECONOMY"


@dataclass(frozen=True)
class SalesTables:
    orders: DataFrame
    items: DataFrame
    products: DataFrame


def _pence(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _scan(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    # The explicit schema reads wall-clock columns as UTC instants, so period predicates
    # are compared with the raw column and reach the scan.
    return spark.read.schema(schema).parquet(f"{folder}/{table}.parquet")


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    raw = _scan(
        spark, folder, "orders",
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
        " o_orderdate timestamp, o_orderpriority string",
    )
    channels = F.create_map(*[F.lit(x) for p in CHANNEL_BY_PRIORITY.items() for x in p])
    return raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("occurred_at"),
        F.coalesce(F.try_element_at(channels, F.col("o_orderpriority")), F.lit("unknown"))
        .alias("channel"),
        F.when(F.col("o_orderstatus") == REFUND_STATUS, F.lit("refund"))
        .otherwise(F.lit("payment")).alias("event_type"),
    )


def line_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Unsigned line measures."""
    raw = _scan(
        spark, folder, "lineitem",
        "l_orderkey bigint, l_partkey bigint, l_quantity double,"
        " l_extendedprice double, l_discount double",
    )
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return raw.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        _pence(price).alias("line_total"),
        _pence(price * discount).alias("discount_amount"),
    )


def product_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    raw = _scan(
        spark, folder, "part",
        "p_partkey bigint, p_name string, p_brand string, p_type string",
    )
    kind = (
        F.when(F.col("p_type") == VOUCHER_TYPE, F.lit("gift_voucher"))
        .when(F.col("p_type") == OPEN_PRICE_TYPE, F.lit("custom_amount"))
        .otherwise(F.lit("menu_item"))
    )
    return raw.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("variation"),
        F.col("p_type").alias("category"),
        kind.alias("kind"),
    )


def sales_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the totals of their lines, refunds negative; 0 where there are no lines."""
    headers = order_headers(spark, folder)
    totals = line_amounts(spark, folder).groupBy("order_id").agg(
        F.sum("line_total").alias("gross"),
        F.sum("discount_amount").alias("discount"),
        F.sum("quantity").alias("units"),
    )
    sign = F.when(F.col("event_type") == "refund", F.lit(-1)).otherwise(F.lit(1))

    def signed(name: str) -> Column:
        return (sign * F.coalesce(F.col(name), F.lit(0))).cast("bigint")

    return headers.join(totals, "order_id", "left").select(
        "order_id", "customer_id", "occurred_at", "channel", "event_type",
        signed("gross").alias("gross_amount"),
        signed("discount").alias("discount_amount"),
        (signed("gross") - signed("discount")).alias("net_amount"),
        signed("units").alias("item_count"),
    )


def sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines signed by their order's event."""
    events = order_headers(spark, folder).select("order_id", "event_type")
    sign = F.when(F.col("event_type") == "refund", F.lit(-1)).otherwise(F.lit(1))
    joined = line_amounts(spark, folder).join(events, "order_id")
    return joined.select(
        "order_id", "product_id",
        *[(sign * F.col(c)).cast("bigint").alias(c)
          for c in ("quantity", "line_total", "discount_amount")],
    )


def sales_tables(spark: SparkSession, folder: str) -> SalesTables:
    """Orders and lines for product work; lines join the light order headers.

    Product operators never read order totals, so the headers stand in for the orders and
    no line is aggregated twice.
    """
    return SalesTables(
        order_headers(spark, folder), sales_lines(spark, folder),
        product_catalogue(spark, folder),
    )


def event_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One order per event: errors are refunds, every other type is a payment."""
    raw = _scan(
        spark, folder, "events",
        "event_id bigint, ts timestamp, event_type string, value double",
    )
    refund = F.col("event_type") == "error"
    sign = F.when(refund, F.lit(-1)).otherwise(F.lit(1))
    pence = (sign * _pence(F.col("value"))).cast("bigint")
    return raw.select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("occurred_at"),
        F.col("event_type").alias("channel"),
        F.when(refund, F.lit("refund")).otherwise(F.lit("payment")).alias("event_type"),
        pence.alias("gross_amount"),
        F.lit(0).cast("bigint").alias("discount_amount"),
        pence.alias("net_amount"),
        sign.cast("bigint").alias("item_count"),
    )


def nation_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer's nation as ``series_id``."""
    customers = _scan(spark, folder, "customer", "c_custkey bigint, c_nationkey int")
    nations = _scan(spark, folder, "nation", "n_nationkey int, n_name string")
    named = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("series_id")
    )
    return sales_orders(spark, folder).join(named, "customer_id")
