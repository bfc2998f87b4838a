"""What was bought together.

A basket is the set of distinct products of one payment order. Orders with the same set
are merged into one weighted basket before any pair is formed, so a million identical
orders emit their pairs once. Very wide baskets never become one array: their products are
dealt into blocks and paired block against block, which spreads one order over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import ratios
from tallyhouse.functions.clock import Period
from tallyhouse.operators.products import lines_in_period
from tallyhouse.schemas import DEFAULT_KINDS

PAIR_SORTS = {"pair_orders": "pair_orders", "lift": "lift", "support": "support_percent"}

# Baskets up to this many distinct products are kept as one array.
ARRAY_WIDTH = 200


def basket_lines(
    orders: DataFrame, items: DataFrame, products: DataFrame, period: Period,
    kinds: Sequence[str] = DEFAULT_KINDS,
) -> DataFrame:
    """Distinct (order_id, product_id) of the period's payment orders."""
    paid = orders.filter(F.col("event_type") == "payment")
    wanted = products.filter(F.col("kind").isin(list(kinds))).select("product_id")
    # Kinds are settled before the order join, which then leaves rows placed by order for
    # everything below: the distinct lines, the widths and the sets.
    eligible = items.join(wanted, "product_id", "left_semi")
    lines = lines_in_period(paid, eligible, period).select("order_id", "product_id")
    # Repeats are dropped along one sort by order and product, which the widths read on. On
    # rows that are placed already, a hash distinct keeps all lines of a task twice beside
    # that sort.
    same = Window.partitionBy("order_id", "product_id").orderBy("product_id")
    return lines.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")


@dataclass(frozen=True)
class Baskets:
    """Weighted product sets, plus the lines of baskets too wide for an array."""

    sets: DataFrame  # items: array<bigint> sorted, orders: bigint
    wide: DataFrame  # order_id, product_id, width, opens (True on one row per order)

    def product_orders(self) -> DataFrame:
        """Payment orders that contain each product."""
        from_sets = self.sets.select(F.explode("items").alias("product_id"), "orders")
        from_wide = self.wide.select("product_id", F.lit(1).cast("bigint").alias("orders"))
        return from_sets.unionByName(from_wide).groupBy("product_id").agg(
            F.sum("orders").alias("product_orders"))

    def eligible_orders(self) -> DataFrame:
        """One row: payment orders with at least one product of the wanted kinds."""
        from_wide = self.wide.filter("opens").select(F.lit(1).cast("bigint").alias("orders"))
        return self.sets.select("orders").unionByName(from_wide).agg(
            F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("eligible_orders"))

    def pair_counts(self, min_pair_orders: int = 1) -> DataFrame:
        """Orders holding both products, for unordered pairs ``a < b`` that reach the minimum."""
        sets, wide = self.sets, self.wide
        if min_pair_orders > 1:
            # A pair cannot be more frequent than its rarer product: products below the
            # minimum are dropped from the wide baskets, whose pairs cost the most.
            frequent = self.product_orders().filter(
                F.col("product_orders") >= min_pair_orders).select("product_id")
            wide = wide.join(frequent, "product_id", "left_semi")
        counted = _array_pairs(sets).unionByName(_block_pairs(wide))
        return (
            counted.groupBy("a", "b").agg(F.sum("orders").alias("pair_orders"))
            .filter(F.col("pair_orders") >= min_pair_orders)
        )


def baskets_of(lines: DataFrame, array_width: int = ARRAY_WIDTH) -> Baskets:
    """Merge distinct basket lines into weighted sets; set wide orders aside."""
    # The width is counted over a spillable window before anything is collected, so no array
    # outgrows the bound and the order placement of the lines is kept.
    order = Window.partitionBy("order_id")
    sized = lines.select(
        "order_id", "product_id", F.count(F.lit(1)).over(order).alias("width"),
        (F.min("product_id").over(order) == F.col("product_id")).alias("opens"),
    )
    sets = (
        sized.filter(F.col("width") <= array_width)
        .groupBy("order_id").agg(F.sort_array(F.collect_list("product_id")).alias("items"))
        # Stated here so the filter the explodes infer is the same one for every reader of
        # the sets, which then share one shuffle.
        .filter(F.size("items") > 0)
        .groupBy("items").agg(F.count(F.lit(1)).alias("orders"))
    )
    return Baskets(sets, sized.filter(F.col("width") > array_width))


def _array_pairs(sets: DataFrame) -> DataFrame:
    firsts = sets.select("items", "orders", F.posexplode("items").alias("at", "a"))
    rest = F.slice("items", F.col("at") + 2, F.greatest(F.size("items") - F.col("at") - 1,
                                                        F.lit(0)))
    return firsts.select("a", F.explode(rest).alias("b"), "orders")


def _block_pairs(wide: DataFrame, block: int = ARRAY_WIDTH) -> DataFrame:
    """Pairs of wide baskets, each (order, block, block) cell an independent join key.

    A product of block ``k`` joins the cells (i, k) and (k, j); the left side of a cell is
    its first block and the right side its second, so every pair meets in exactly one cell
    and no task sees more than block x block pairs of one order.
    """
    blocks = F.ceil(F.col("width") / block).cast("int")
    dealt = wide.select(
        "order_id", "product_id", blocks.alias("blocks"),
        F.pmod(F.xxhash64("product_id"), blocks).cast("int").alias("own"),
    )
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = dealt.select(
        "order_id", F.col("product_id").alias("x"), F.col("own").alias("row"),
        F.explode(F.filter(every, lambda k: k >= F.col("own"))).alias("col"))
    right = dealt.select(
        "order_id", F.col("product_id").alias("y"), F.col("own").alias("col"),
        F.explode(F.filter(every, lambda k: k <= F.col("own"))).alias("row"))
    met = left.join(right, ["order_id", "row", "col"]).filter(
        (F.col("row") != F.col("col")) | (F.col("x") < F.col("y")))
    return met.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.lit(1).cast("bigint").alias("orders"))


def _names(products: DataFrame, prefix: str) -> DataFrame:
    return products.select(
        F.col("product_id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"),
        F.col("variation").alias(f"{prefix}_variation"))


def _with_orders(pairs: DataFrame, baskets: Baskets) -> DataFrame:
    """Pair counts with each side's own order count, 0 where it has none."""
    counts = baskets.product_orders()
    for side in ("a", "b"):
        own = counts.select(F.col("product_id").alias(side),
                            F.col("product_orders").alias(f"{side}_orders"))
        pairs = pairs.join(own, side, "left")
    return pairs.select("a", "b", "pair_orders",
                        F.coalesce("a_orders", F.lit(0)).alias("a_orders"),
                        F.coalesce("b_orders", F.lit(0)).alias("b_orders"))


def basket_pairs(
    baskets: Baskets, products: DataFrame, min_pair_orders: int = 1,
    sort: str = "pair_orders", limit: int | None = None,
) -> DataFrame:
    """Unordered pairs with support, both confidences and lift."""
    if sort not in PAIR_SORTS:
        raise ValueError(f"sort must be one of {sorted(PAIR_SORTS)}, got {sort!r}")
    eligible = baskets.eligible_orders().scalar()
    pair, a, b = F.col("pair_orders"), F.col("a_orders"), F.col("b_orders")
    measured = _with_orders(baskets.pair_counts(min_pair_orders), baskets).select(
        F.col("a").alias("product_a_id"), F.col("b").alias("product_b_id"),
        "pair_orders", a.alias("product_a_orders"), b.alias("product_b_orders"),
        ratios.percent(pair, eligible, 4).alias("support_percent"),
        ratios.percent(pair, a, 4).alias("confidence_a_to_b_percent"),
        ratios.percent(pair, b, 4).alias("confidence_b_to_a_percent"),
        ratios.lift(pair, a, b, eligible).alias("lift"),
    )
    named = (
        measured.join(_names(products, "product_a"), "product_a_id")
        .join(_names(products, "product_b"), "product_b_id")
    )
    ranked = named.select(
        "product_a_id", "product_a_name", "product_a_variation",
        "product_b_id", "product_b_name", "product_b_variation",
        "pair_orders", "product_a_orders", "product_b_orders", "support_percent",
        "confidence_a_to_b_percent", "confidence_b_to_a_percent", "lift",
    ).orderBy(
        F.desc_nulls_last(PAIR_SORTS[sort]), "product_a_name", "product_a_variation",
        "product_b_name", "product_b_variation", "product_a_id", "product_b_id",
    )
    return ranked if limit is None else ranked.limit(limit)


def pair_totals(baskets: Baskets, min_pair_orders: int = 1) -> DataFrame:
    """Eligible orders, distinct products and qualifying pairs, each before any limit."""
    return baskets.eligible_orders().select(
        F.col("eligible_orders").alias("eligible_order_count"),
        baskets.product_orders().agg(F.count(F.lit(1))).scalar()
        .alias("distinct_product_count"),
        baskets.pair_counts(min_pair_orders).agg(F.count(F.lit(1))).scalar()
        .alias("qualifying_pair_count"),
    )


def product_attachments(
    lines: DataFrame, products: DataFrame, anchor_id: int, min_pair_orders: int = 1,
    limit: int | None = None,
) -> DataFrame | None:
    """What else was in the basket with the anchor; None for an unknown product.

    Works on basket lines directly: the anchor's orders restrict the lines by a semi join,
    so no pair of other products is formed.
    """
    if products.filter(F.col("product_id") == anchor_id).isEmpty():
        return None
    with_anchor = lines.filter(F.col("product_id") == anchor_id).select("order_id")
    together = (
        lines.filter(F.col("product_id") != anchor_id)
        .join(with_anchor, "order_id", "left_semi")
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("pair_orders"))
        .filter(F.col("pair_orders") >= min_pair_orders)
    )
    own = lines.groupBy("product_id").agg(F.count(F.lit(1)).alias("product_orders"))
    # One global aggregate answers both the anchor's count and the population.
    eligible = lines.agg(F.count_distinct("order_id").alias("n")).scalar()
    anchor = with_anchor.agg(F.count(F.lit(1)).alias("n")).scalar()
    pair, other = F.col("pair_orders"), F.col("product_orders")
    measured = together.join(own, "product_id", "left").select(
        "product_id", "pair_orders",
        F.coalesce(other, F.lit(0)).alias("product_orders"),
        ratios.percent(pair, anchor, 4).alias("attachment_rate_percent"),
        ratios.percent(pair, other, 4).alias("reverse_attachment_rate_percent"),
        ratios.percent(pair, eligible, 4).alias("support_percent"),
        ratios.lift(pair, anchor, other, eligible).alias("lift"),
    )
    ranked = measured.join(_names(products, "product"), "product_id").select(
        "product_id", "product_name", "product_variation", "pair_orders", "product_orders",
        "attachment_rate_percent", "reverse_attachment_rate_percent", "support_percent",
        "lift",
    ).orderBy(F.desc("pair_orders"), "product_name", "product_variation", "product_id")
    return ranked if limit is None else ranked.limit(limit)


def attachment_totals(lines: DataFrame, anchor_id: int) -> DataFrame:
    """Orders that hold the anchor, and all eligible orders."""
    anchored = F.when(F.col("product_id") == anchor_id, F.lit(1))
    return lines.agg(
        F.count(anchored).alias("anchor_order_count"),
        F.count_distinct("order_id").alias("eligible_order_count"),
    )


def strongest_attachments(
    baskets: Baskets, products: DataFrame, min_pair_orders: int = 5
) -> DataFrame:
    """Each product's partner of highest lift; pair count, then the later name, break ties."""
    eligible = baskets.eligible_orders().scalar()
    pairs = _with_orders(baskets.pair_counts(min_pair_orders), baskets)
    both_ways = pairs.select(
        "pair_orders",
        F.explode(F.array(
            F.struct(F.col("a").alias("anchor"), F.col("b").alias("partner"),
                     F.col("a_orders").alias("anchor_orders"),
                     F.col("b_orders").alias("partner_orders")),
            F.struct(F.col("b").alias("anchor"), F.col("a").alias("partner"),
                     F.col("b_orders").alias("anchor_orders"),
                     F.col("a_orders").alias("partner_orders")),
        )).alias("side"),
    ).select("pair_orders", "side.*")
    pair, a, b = F.col("pair_orders"), F.col("anchor_orders"), F.col("partner_orders")
    measured = both_ways.select(
        "anchor", F.col("partner").alias("attachment_product_id"),
        pair.alias("attachment_pair_orders"),
        ratios.percent(pair, a, 4).alias("attachment_rate_percent"),
        ratios.lift(pair, a, b, eligible).alias("attachment_lift"),
    ).join(_names(products, "attachment_product"), "attachment_product_id")
    fields = ["attachment_product_id", "attachment_product_name",
              "attachment_product_variation", "attachment_pair_orders",
              "attachment_rate_percent", "attachment_lift"]
    rank: list[Column] = [
        F.coalesce("attachment_lift", F.lit(0.0)), F.col("attachment_pair_orders"),
        F.col("attachment_product_name"), F.col("attachment_product_variation"),
        F.col("attachment_product_id"),
    ]
    best = measured.groupBy(F.col("anchor").alias("product_id")).agg(
        F.max_by(F.struct(*fields), F.struct(*rank)).alias("best"))
    return best.select("product_id", "best.*")
