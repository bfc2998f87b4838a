"""Helpers over finished results: limits with counts, text filters, undefined flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import contains_text, product_label


@dataclass(frozen=True)
class Limited:
    """The first rows of a ranking, and a one-row frame that says what was left out."""

    rows: DataFrame
    counts: DataFrame


def limited(ranked: DataFrame, limit: int | None) -> Limited:
    rows = ranked if limit is None else ranked.limit(limit)
    available = ranked.agg(F.count(F.lit(1)).alias("available_rows"))
    cap = F.lit(limit).cast("bigint")
    returned = F.least("available_rows", cap) if limit is not None else F.col("available_rows")
    counts = available.select(
        returned.alias("returned_rows"), "available_rows",
        cap.alias("applied_limit"),
        (F.col("available_rows") > returned).alias("truncated"),
    )
    return Limited(rows, counts)


def search_products(rows: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over name and variation; blank text keeps everything."""
    return rows.filter(contains_text(text, F.col("product_name"), F.col("product_variation")))


def without_zero_revenue(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("net_sales_pence") != 0)


def pair_labels(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "*",
        product_label(F.col("product_a_name"), F.col("product_a_variation")).alias("label_a"),
        product_label(F.col("product_b_name"), F.col("product_b_variation")).alias("label_b"),
    )


def pair_points(pairs: DataFrame) -> DataFrame:
    """Count against lift, for pairs whose lift is defined."""
    return pair_labels(pairs).filter(F.col("lift").isNotNull()).select(
        "product_a_id", "product_b_id", "label_a", "label_b", "pair_orders", "lift",
        "support_percent", "confidence_a_to_b_percent", "confidence_b_to_a_percent",
    )


def search_pairs(pairs: DataFrame, text: str) -> DataFrame:
    """Pairs where the text occurs in either product's label."""
    labelled = pair_labels(pairs)
    kept = labelled.filter(contains_text(text, F.col("label_a"), F.col("label_b")))
    return kept.drop("label_a", "label_b")


def undefined_flags(rows: DataFrame) -> DataFrame:
    """One row: does any value hold NULL, and did nothing sell at all."""
    any_null = F.lit(False)
    for name in rows.columns:
        any_null = any_null | F.col(name).isNull()
    empty = (
        F.coalesce(F.max(F.coalesce("payment_order_count", F.lit(0)) != 0), F.lit(True))
        == F.lit(False)
        if "payment_order_count" in rows.columns else F.lit(False)
    )
    return rows.agg(
        F.coalesce(F.max(any_null), F.lit(False)).alias("has_undefined"),
        empty.alias("is_empty_period"),
    )
