"""Export rows to canonical orders, lines and issues.

Each row is parsed once into typed columns plus at most one skipping ``issue``; everything
after that is filters and joins over the parsed rows. Store the parsed rows before building
on them: many branches read them, and a filter on ``issue`` would otherwise be pushed into
the text parsing of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import clock, labels, money
from tallyhouse.functions.text import stripped
from tallyhouse.schemas import SKIP, WARN
from tallyhouse.sources.exports import ROW_KEYS

ISSUE_FIELDS = ("row_number", "code", "severity", "message", "field", "source_order_id")
LINE_FIELDS = ("name", "variation", "quantity", "unit_price", "line_total", "discount_amount")


def _issue(code: str, message: Column | str, field: str | None = None,
           severity: str = SKIP) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                    text.alias("message"), F.lit(field).cast("string").alias("field"))


def _quoted(lead: str, value: Column) -> Column:
    return F.concat(F.lit(lead + " '"), value, F.lit("'"))


# --- parsing ----------------------------------------------------------------------------


def parse_transactions(raw: DataFrame) -> DataFrame:
    """Typed transaction rows; ``issue`` is the first structural fault, in checking order."""
    # One projection after another: each keeps what the next reads several times in a column,
    # so no expression is repeated inside another.
    clean = raw.select(*ROW_KEYS, *[stripped(F.col(c)).alias(c) for c in (
        "Date", "Time", "Time Zone", "Discounts", "Net Sales", "Transaction ID", "Payment ID",
        "Event Type", "Source")], labels.dining_key(F.col("Dining Option")).alias("options"),
        labels.folded(F.col("Source")).alias("origin"))
    origin, options = F.col("origin"), F.col("options")
    typed = clean.select(
        *ROW_KEYS,
        F.col("Transaction ID").alias("source_order_id"),
        F.nullif("Payment ID", F.lit("")).alias("source_payment_id"),
        labels.event_of(F.col("Event Type")).alias("event_type"),
        clock.zone_of(F.col("Time Zone")).alias("zone"),
        clock.clean_wall_time(F.col("Date"), F.col("Time")).alias("wall"),
        money.clean_pence(F.col("Net Sales")).alias("net_amount"),
        # Exports write discounts negative; negating keeps the sign aligned on refunds.
        (-money.clean_pence(F.col("Discounts"))).alias("discount_amount"),
        labels.keyed_channel(origin, options).alias("own_channel"),
        labels.channel_reason(F.col("Source"), origin, options).alias("reason"),
        "Event Type", "Time Zone", "Date", "Time", "Net Sales", "Discounts",
    )
    wall, zone, instant = F.col("wall"), F.col("zone"), F.col("occurred_at")
    typed = typed.withColumn("occurred_at", clock.first_instant(wall, zone))
    clock_read = F.concat_ws(" ", "Date", "Time")
    issue = (
        F.when(F.col("source_order_id") == "", _issue(
            "missing_transaction_id", "row carries no order id", "Transaction ID"))
        .when(F.col("event_type").isNull(), _issue(
            "unknown_event_type", _quoted("no known kind of event:", F.col("Event Type")),
            "Event Type"))
        .when(zone.isNull(), _issue(
            "unknown_time_zone", _quoted("unrecognised time zone", F.col("Time Zone")),
            "Time Zone"))
        .when(wall.isNull(), _issue(
            "unparsable_timestamp", _quoted("cannot read date and time", clock_read), "Time"))
        .when(clock.in_clock_gap(wall, instant, zone), _issue(
            "nonexistent_local_time", _quoted("clocks skipped", clock_read), "Time"))
        .when(F.col("net_amount").isNull() | F.col("discount_amount").isNull(), _issue(
            "unparsable_money",
            F.concat(_quoted("cannot read", F.col("Net Sales")),
                     _quoted(" or", F.col("Discounts"))), "Net Sales/Discounts"))
    )
    # A row that fails on money has a sound clock, and its ambiguity is still reported.
    checked = typed.withColumn("issue", issue)
    code = F.coalesce(F.col("issue.code"), F.lit(""))
    timed = code.isin("", "unparsable_money")
    return checked.select(
        *ROW_KEYS, "source_order_id", "source_payment_id", "event_type", "occurred_at",
        F.coalesce(timed & clock.occurs_twice(wall, instant, zone), F.lit(False))
        .alias("ambiguous"),
        "net_amount", "discount_amount", "own_channel", "reason", "issue",
    )


def parse_items(raw: DataFrame) -> DataFrame:
    """Typed item rows; checked for id, quantity, money, then zero quantity."""
    clean = raw.select(*ROW_KEYS, "Category", *[stripped(F.col(c)).alias(c) for c in (
        "Item", "Price Point Name", "Modifiers Applied", "Qty", "Product Sales", "Discounts",
        "Transaction ID")])
    typed = clean.select(
        *ROW_KEYS, F.col("Transaction ID").alias("source_order_id"), F.col("Item").alias("name"),
        F.col("Price Point Name").alias("variation"),
        labels.category_of(F.col("Category")).alias("category"),
        labels.kind_of(F.col("Item")).alias("kind"),
        money.clean_quantity(F.col("Qty")).alias("quantity"),
        money.clean_pence(F.col("Product Sales")).alias("line_total"),
        (-money.clean_pence(F.col("Discounts"))).alias("discount_amount"),
        F.nullif("Modifiers Applied", F.lit("")).alias("modifiers"),
        "Qty", "Product Sales", "Discounts",
    )
    quantity, total = F.col("quantity"), F.col("line_total")
    issue = (
        F.when(F.col("source_order_id") == "", _issue(
            "missing_transaction_id", "line carries no order id", "Transaction ID"))
        .when(quantity.isNull(), _issue(
            "unparsable_quantity", _quoted("not a whole quantity:", F.col("Qty")), "Qty"))
        .when(total.isNull() | F.col("discount_amount").isNull(), _issue(
            "unparsable_money",
            F.concat(_quoted("cannot read", F.col("Product Sales")),
                     _quoted(" or", F.col("Discounts"))), "Product Sales/Discounts"))
        .when(quantity == 0, _issue(
            "unparsable_quantity", "line of nothing", "Qty"))
    )
    return typed.select(
        *ROW_KEYS, "source_order_id", "name", "variation", "category", "kind", "quantity",
        money.unit_price(total, quantity).alias("unit_price"), "line_total", "discount_amount",
        "modifiers", issue.alias("issue"),
    )


def sound(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("issue").isNull())


def row_issues(parsed: DataFrame) -> DataFrame:
    """The skipping issues of parsed rows."""
    return parsed.filter(F.col("issue").isNotNull()).select(
        *ROW_KEYS, "issue.*", F.nullif("source_order_id", F.lit("")).alias("source_order_id"))


def _noted(rows: DataFrame, issue: Column) -> DataFrame:
    return rows.select(*ROW_KEYS, issue.alias("issue"), "source_order_id").select(
        *ROW_KEYS, "issue.*", "source_order_id")


# --- transactions to orders ----------------------------------------------------------------


def _order_fields(rows: DataFrame, channel: Column, source: str) -> DataFrame:
    # The export's own gross is already net of discounts; ours is before them.
    return rows.select(
        *ROW_KEYS, F.lit(source).alias("source"), "source_order_id", "source_payment_id",
        "occurred_at", channel.alias("channel"), "event_type",
        (F.col("net_amount") + F.col("discount_amount")).alias("gross_amount"),
        "discount_amount", "net_amount",
    )


def _payments(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments with a value, and those worth nothing."""
    paid = sound(parsed).filter(F.col("event_type") == "payment")
    nothing = (F.col("net_amount") == 0) & (F.col("discount_amount") == 0)
    return paid.filter(~nothing), paid.filter(nothing)


def unresolved_payments(parsed: DataFrame) -> DataFrame:
    """Valued payments whose channel could not be derived; they stop an import."""
    valued, _ = _payments(parsed)
    return _noted(valued.filter(F.col("own_channel").isNull()), _issue(
        "unresolved_channel", F.concat(F.lit("no channel follows from "), F.col("reason")),
        "Source/Dining Option"))


def zero_value_payments(parsed: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments of nothing, split by whether the item file shows something was served."""
    _, nothing = _payments(parsed)
    served = sound(items).select("source_order_id").distinct()
    return (nothing.join(served, "source_order_id", "left_semi"),
            nothing.join(served, "source_order_id", "left_anti"))


def refund_channels(parsed: DataFrame) -> DataFrame:
    """Refunds with the channel ``inherited`` from the payment they reverse, if it is here.

    The last valued payment of a payment id counts, in file order.
    """
    valued, _ = _payments(parsed)
    place = F.struct(*ROW_KEYS)
    origin = valued.filter(
        F.col("source_payment_id").isNotNull() & F.col("own_channel").isNotNull()
    ).groupBy("source_payment_id").agg(F.max_by("own_channel", place).alias("inherited"))
    refunds = sound(parsed).filter(F.col("event_type") == "refund")
    return refunds.join(origin, "source_payment_id", "left")


def build_orders(parsed: DataFrame, items: DataFrame, source: str) -> DataFrame:
    """Every analytic order of an extraction, with its signed item count."""
    valued, _ = _payments(parsed)
    served, _ = zero_value_payments(parsed, items)
    refunds = refund_channels(parsed)
    own = F.col("own_channel")
    kept = valued.unionByName(served).filter(own.isNotNull())
    orders = _order_fields(kept, own, source).unionByName(_order_fields(
        refunds, F.coalesce("inherited", "own_channel", F.lit("unknown")), source))
    counts = sound(items).groupBy("source_order_id").agg(F.sum("quantity").alias("item_count"))
    counted = orders.join(counts, "source_order_id", "left")
    return counted.withColumn("item_count", F.coalesce("item_count", F.lit(0)).cast("bigint"))


def transaction_issues(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Everything worth reporting about transaction rows, with their row keys."""
    served, idle = zero_value_payments(parsed, items)
    refunds = refund_channels(parsed)
    inherited, own = F.col("inherited"), F.col("own_channel")
    told = (
        F.when(inherited.isNotNull(), _issue(
            "refund_channel_inherited",
            F.concat(F.lit("refund of payment "), F.col("source_payment_id"),
                     _quoted(" takes its channel", inherited)), "Payment ID", WARN))
        .when(own.isNotNull(), _issue(
            "refund_channel_derived",
            F.concat(F.lit("no file holds its payment; "), _quoted("its own cells give channel", own),
                     F.lit(": "), F.col("reason")),
            "Source/Dining Option", WARN))
        .otherwise(_issue(
            "refund_channel_unknown",
            F.concat(F.lit("no file holds its payment, and "), F.col("reason"),
                     F.lit("; its channel is stored as 'unknown'")), "Payment ID", WARN))
    )
    parts = [
        row_issues(parsed),
        unresolved_payments(parsed),
        _noted(parsed.filter("ambiguous"), _issue(
            "ambiguous_local_time", "local time occurs twice; the first was taken", "Time",
            WARN)),
        _noted(idle, _issue(
            "zero_value_transaction", "payment of nothing without items, left out")),
        _noted(served.filter(own.isNotNull()), _issue(
            "zero_value_order_retained", "payment of nothing with item lines, kept", None,
            WARN)),
        _noted(refunds, told),
    ]
    return _union(parts)


def orphan_issues(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One warning per order id that item rows name and no order has."""
    lost = sound(items).join(orders.select("source_order_id"), "source_order_id", "left_anti")
    groups = lost.groupBy("source_order_id").agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.col("n"), F.lit(" item row(s) belong to no analytic order"))
    return groups.select(_issue("orphan_item", message, None, WARN).alias("i"),
                         "source_order_id").select(
        F.lit(0).cast("bigint").alias("row_number"), "i.*", "source_order_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


# --- against what is stored -------------------------------------------------------------------


ORDER_FIELDS = ("occurred_at", "channel", "event_type", "gross_amount", "discount_amount",
                "net_amount", "item_count", "source_payment_id")
ORDER_KEY = ["source", "source_order_id"]


NO_LINES = "0"
_SALTS = (11, 23)


def line_digest(lines: DataFrame) -> DataFrame:
    """One row per order: its key and an order-free digest of its lines.

    Lines are hashed under two salts and the halves of the hashes are summed, with the number
    of lines beside them, so equal multisets of lines have equal digests in any sequence.
    Sums combine before the shuffle; no order's lines are ever collected or joined.
    """
    # Hashes pass over nulls and tell integer widths apart.
    fields = [x for c in LINE_FIELDS for x in (
        F.col(c).cast("string" if c in ("name", "variation") else "bigint"), F.col(c).isNull())]
    hashes = [F.xxhash64(F.lit(salt), *fields) for salt in _SALTS]
    halves = [h for x in hashes for h in (
        x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(x, 32))]
    return lines.groupBy(*ORDER_KEY).agg(F.concat_ws(
        "-", F.count(F.lit(1)), *(F.sum(h) for h in halves)).alias("line_digest"))


def with_line_digest(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with the digest of their lines; `NO_LINES` where they have none."""
    return orders.join(line_digest(lines), ORDER_KEY, "left").fillna(NO_LINES, ["line_digest"])


def compare_with_stored(incoming: DataFrame, lines: DataFrame, stored: DataFrame,
                        stored_lines: DataFrame) -> DataFrame:
    """`compare_orders` of orders whose digests are not stored yet."""
    return compare_orders(with_line_digest(incoming, lines), with_line_digest(stored, stored_lines))


def compare_orders(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Orders present on both sides, with the fields in which they differ.

    Both hold the order key, the order fields and `line_digest`. An empty ``differences``
    array means an identical re-delivery; no line is read for it.
    """
    fields = (*ORDER_FIELDS, "line_digest")
    both = incoming.select(*ORDER_KEY, *[F.col(c).alias(f"new_{c}") for c in fields]
                           ).join(stored.select(*ORDER_KEY, *fields), ORDER_KEY)

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("NULL"))

    told = [
        F.when(~F.col(f"new_{c}").eqNullSafe(F.col(c)), F.concat(
            F.lit(f"{c} incoming="), shown(F.col(f"new_{c}")), F.lit(" stored="),
            shown(F.col(c))))
        for c in ORDER_FIELDS
    ]
    told.append(F.when(~F.col("new_line_digest").eqNullSafe(F.col("line_digest")),
                       F.lit("line_items differ")))
    return both.select(
        *ORDER_KEY, F.filter(F.array(*told), lambda d: d.isNotNull()).alias("differences"))


def duplicate_issues(compared: DataFrame) -> DataFrame:
    same = compared.filter(F.size("differences") == 0)
    told = _issue("duplicate_order", "identical order already imported", "Transaction ID")
    return same.select(told.alias("i"), "source_order_id").select(
        F.lit(0).cast("bigint").alias("row_number"), "i.*", "source_order_id")


def repeated_keys(orders: DataFrame) -> DataFrame:
    """Order keys that occur more than once; must be empty before anything is written."""
    return orders.groupBy(*ORDER_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def new_products(lines: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Products of the lines the catalogue lacks, one row per (name, variation).

    Known products keep their stored kind. Of several spellings of category and kind the
    last row's counts.
    """
    named = lines.groupBy("name", "variation").agg(
        F.max_by(F.struct("category", "kind"), F.struct(*ROW_KEYS)).alias("p"))
    fresh = named.join(catalogue.select("name", "variation"), ["name", "variation"], "left_anti")
    return fresh.select("name", "variation", "p.category", "p.kind")


# --- reconciliation ------------------------------------------------------------------------------


def summary_rows(summary: DataFrame) -> DataFrame:
    """Money and units of an items summary; NULL where a cell cannot be read."""
    def units(name: str) -> Column:
        blank = stripped(F.col(f"`{name}`")) == ""
        return F.when(blank, F.lit(0).cast("bigint")).otherwise(
            money.whole_quantity(F.col(f"`{name}`")))

    return summary.select(
        money.money_to_pence(F.col("Net Sales")).alias("net_sales"),
        # A summary writes refunds below zero, so its columns are summed as they are.
        (money.money_to_pence(F.col("Product Sales")) + money.money_to_pence(F.col("Refunds")))
        .alias("line_totals"),
        (units("Units Sold") + units("Items Refunded")).alias("units"),
    )


def reconciliation(orders: DataFrame, lines: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: our totals, the summary's, and whether all three agree exactly."""
    def total(frame: DataFrame, column: str) -> Column:
        return frame.agg(F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias("t")).scalar()

    theirs = summary_rows(summary).agg(
        F.count(F.lit(1)).alias("summary_rows"),
        F.count(F.when(F.col("net_sales").isNull() | F.col("line_totals").isNull()
                       | F.col("units").isNull(), F.lit(1))).alias("unreadable_rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"{c}_theirs")
          for c in ("net_sales", "line_totals", "units")],
    )
    both = theirs.select(
        "*", total(orders, "net_amount").alias("net_sales_ours"),
        total(lines, "line_total").alias("line_totals_ours"),
        total(lines, "quantity").alias("units_ours"),
    )
    equal = F.lit(True)
    for c in ("net_sales", "line_totals", "units"):
        equal = equal & (F.col(f"{c}_ours") == F.col(f"{c}_theirs"))
    return both.withColumn("matches", equal)


def summarise_lines(lines: DataFrame) -> DataFrame:
    """Sold and refunded units and money per product, split by the sign of the quantity."""
    sold = F.col("quantity") >= 0

    def part(condition: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("bigint")

    return lines.groupBy("name", "variation").agg(
        part(sold, "quantity").alias("items_sold"),
        part(~sold, "quantity").alias("items_refunded"),
        part(sold, "line_total").alias("product_sales"),
        part(~sold, "line_total").alias("refunds"),
        (-F.sum("discount_amount")).cast("bigint").alias("discounts"),
        F.sum(F.col("line_total") - F.col("discount_amount")).cast("bigint").alias("net_sales"),
    )
