"""Table schemas and the closed vocabularies stored in them."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: stored vocabularies ------------------------------------------
CHANNELS = ("in_store", "collection", "delivery", "mixed", "online", "unknown")
EVENT_TYPES = ("payment", "refund")
PRODUCT_KINDS = ("menu_item", "gift_voucher", "custom_amount")
IMPORT_STATUSES = ("pending", "processing", "completed", "failed")
FILE_ROLES = ("transactions", "items_detail", "items_summary")
SKIP, WARN = "skip", "warn"
ISSUE_CODES = (
    "unresolved_channel",
    "zero_value_transaction",
    "zero_value_order_retained",
    "ambiguous_local_time",
    "nonexistent_local_time",
    "unknown_time_zone",
    "unparsable_timestamp",
    "unparsable_money",
    "unparsable_quantity",
    "unknown_event_type",
    "missing_transaction_id",
    "orphan_item",
    "duplicate_order",
    "refund_channel_inherited",
    "refund_channel_derived",
    "refund_channel_unknown",
)
# --- end of fixed values ----------------------------------------------------------

DEFAULT_KINDS = ("menu_item",)
DEFAULT_ZONE = "Europe/London"


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
             "instant": T.TimestampType(), "date": T.DateType()}
    fields = []
    for part in spec.split(","):
        name, kind = part.strip().split(" ")
        fields.append(T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


ORDERS = _struct(
    "order_id long, source string, source_order_id string, source_payment_id string?,"
    " occurred_at instant, channel string, event_type string, gross_amount long,"
    " discount_amount long, net_amount long, item_count long"
)
ORDER_ITEMS = _struct(
    "order_id long, product_id long, quantity long, unit_price long,"
    " line_total long, discount_amount long"
)
PRODUCTS = _struct(
    "product_id long, name string, variation string, category string?, kind string"
)
IMPORT_BATCHES = _struct(
    "batch_id long, label string?, period_start date?, period_end date?,"
    " status string, imported_at instant, error_log string?"
)
IMPORT_FILES = _struct(
    "batch_id long, role string, filename string, file_checksum string,"
    " row_count long, rows_imported long, rows_skipped long"
)
DAY_TOTALS = _struct(
    "day date, channel string, net_sales_pence long, gross_sales_pence long,"
    " discounts_pence long, payment_order_count long, net_units long, refund_event_count long"
)
ISSUES = _struct(
    "row_number long, code string, severity string, message string,"
    " field string?, source_order_id string?"
)
