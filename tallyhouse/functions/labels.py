"""Classification of export cells into the stored vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.text import stripped

# --- fixed values: how orders reach the business ----------------------------------
DELIVERY_SOURCES = ("uber eats", "just eat", "deliveroo")
ONLINE_SOURCES = ("square online",)
COUNTER_SOURCES = ("point of sale", "register")
PICKUP_SUFFIX = " pickup"
# Set of dining options (sorted, joined by "+") to channel.
DINING_CHANNELS = {
    "eat in": "in_store",
    "takeaway": "in_store",
    "pick up": "collection",
    "eat in+takeaway": "mixed",
    "eat in+pick up": "mixed",
    "pick up+takeaway": "mixed",
}
# --- fixed values: product and category names ----------------------------------------
CUSTOM_AMOUNT_NAME = "custom amount"
VOUCHER_MARKERS = ("gift voucher", "gift card")
NO_CATEGORY = ("", "none", "uncategorised", "uncategorized")
# --- end of fixed values ----------------------------------------------------------------


def folded(value: Column) -> Column:
    return F.lower(stripped(value))


def dining_key(dining: Column) -> Column:
    """Comma list as an order-free set key; empty when no option is given."""
    parts = F.transform(F.split(F.coalesce(dining, F.lit("")), ","), folded)
    kept = F.filter(parts, lambda part: part != "")
    return F.array_join(F.array_sort(F.array_distinct(kept)), "+")


def channel_of(source: Column, dining: Column) -> Column:
    """Channel, or NULL where the source and dining option do not settle one."""
    return keyed_channel(folded(source), dining_key(dining))


def keyed_channel(origin: Column, options: Column) -> Column:
    """The same from a folded source and a dining key held in columns."""
    mapping = F.create_map(*[F.lit(x) for pair in DINING_CHANNELS.items() for x in pair])
    dined = F.try_element_at(mapping, options)
    return (
        F.when(origin.endswith(PICKUP_SUFFIX), F.lit("collection"))
        .when(origin.isin(*DELIVERY_SOURCES), F.lit("delivery"))
        .when(origin.isin(*ONLINE_SOURCES), F.coalesce(dined, F.lit("online")))
        .when(origin.isin(*COUNTER_SOURCES), dined)
    )


def channel_reason(source: Column, origin: Column, options: Column) -> Column:
    """Why :func:`keyed_channel` gave the answer it did, for issue messages."""
    named = F.concat(F.lit("'"), source, F.lit("'"))
    option = F.concat(F.lit("'"), options, F.lit("'"))
    return (
        F.when(origin.endswith(PICKUP_SUFFIX), F.concat(F.lit("collected, by its source "), named))
        .when(origin.isin(*DELIVERY_SOURCES), F.concat(F.lit("carried by "), named))
        .when(origin.isin(*ONLINE_SOURCES), F.concat(F.lit("ordered on "), named))
        .when(
            origin.isin(*COUNTER_SOURCES) & (options == ""),
            F.concat(F.lit("till "), named, F.lit(", which says nothing of where it is eaten")),
        )
        .when(
            origin.isin(*COUNTER_SOURCES),
            F.concat(F.lit("till "), named, F.lit(" and its option "), option),
        )
        .otherwise(F.concat(F.lit("unknown source "), named))
    )


def kind_of(name: Column) -> Column:
    text = folded(name)
    voucher = F.lit(False)
    for marker in VOUCHER_MARKERS:
        voucher = voucher | text.contains(marker)
    return (
        F.when(text == CUSTOM_AMOUNT_NAME, F.lit("custom_amount"))
        .when(voucher, F.lit("gift_voucher"))
        .otherwise(F.lit("menu_item"))
    )


def category_of(raw: Column) -> Column:
    """Category text, or NULL for the spellings that mean there is none."""
    return F.when(~folded(raw).isin(*NO_CATEGORY), stripped(raw))


def event_of(raw: Column) -> Column:
    text = folded(raw)
    return F.when(text.isin("payment", "refund"), text)
