"""One import: exports in, reconciled and committed tables out, or an error and no rows.

Parsed rows are staged once as Parquet, because the checks, joins and writes that follow
read them many times and the text should be parsed only once. All checks run before the
first table is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.clock import local_day, local_month
from tallyhouse.operators import daily, ingest
from tallyhouse.schemas import DEFAULT_ZONE, SKIP
from tallyhouse.sources import exports
from tallyhouse.sources.adapters import SourceAdapter, TillExports
from tallyhouse.sources.exports import SourceFormatError
from tallyhouse.sources.warehouse import Warehouse

REPORTED = 5


class ImportFailed(Exception):
    """The import was started and stopped; nothing of it is visible."""


class ImportRejected(Exception):
    """A file was imported before; the import was never started."""


class UnresolvedChannel(ImportFailed):
    pass


class ConflictingOrder(ImportFailed):
    pass


class RepeatedOrder(ImportFailed):
    pass


class ReconciliationFailed(ImportFailed):
    pass


@dataclass(frozen=True)
class ImportOutcome:
    batch_id: int
    label: str | None
    period_start: date | None
    period_end: date | None
    orders_created: int
    order_items_created: int
    products_created: int
    products_reused: int
    rows_skipped: int
    net_sales_pence: int
    reconciled: bool
    issue_counts: dict[str, int] = field(default_factory=dict)
    # Both sides' totals; None where there was no summary to compare with.
    reconciliation: dict[str, int] | None = None


def import_exports(
    spark: SparkSession, warehouse: Warehouse, transactions: list[str], items: list[str],
    summary: list[str] | None = None, label: str | None = None, source: str = "till",
    zone: str = DEFAULT_ZONE, multiline: bool | None = None,
    adapter: SourceAdapter | None = None,
) -> ImportOutcome:
    """Import one extraction. Each role takes any number of files.

    An ``adapter`` reads another format than till exports, and brings its own source name.
    """
    adapter = adapter or TillExports(source, multiline)
    files = {"transactions": transactions, "items_detail": items}
    if summary:
        files["items_summary"] = summary
    batch_id = warehouse.claim_batch()
    try:
        manifest = _manifest(spark, warehouse, adapter, files, batch_id)
        _reject_known(warehouse, manifest)
    except Exception:
        warehouse.release_claim(batch_id)
        raise
    try:
        return _run(spark, warehouse, adapter, files, manifest, batch_id, label, zone)
    except Exception as error:
        # No checksums are recorded for a failed batch, so it can be tried again.
        supplied = manifest.select("role", "name", "checksum").orderBy("role", "name").collect()
        log = f"{type(error).__name__}: {error}\n\nfiles supplied:\n" + "\n".join(
            f"  {r['role']}: {r['name']} sha256 {r['checksum']}" for r in supplied)
        warehouse.append_batch((batch_id, label, None, None, "failed", _now(), log))
        raise


def _now() -> datetime:
    return datetime.now(timezone.utc)


def import_folder(
    spark: SparkSession, warehouse: Warehouse, folder: str, resume: bool = False,
    zone: str = DEFAULT_ZONE, adapter: SourceAdapter | None = None,
) -> list[ImportOutcome]:
    """Import every month of a folder in order, each as a batch labelled with its month.

    A month that fails stops the later ones, which may rest on it. With ``resume``, months that
    have a completed batch are passed over, so that a stopped import can be taken up again.
    """
    found = exports.discover_batches(spark, folder).collect()
    done = set()
    if resume:
        done = {r["label"] for r in warehouse.import_batches().filter(
            F.col("status") == "completed").select("label").distinct().collect()}
    return [
        import_exports(spark, warehouse, [r["transactions"]], [r["items_detail"]],
                       [r["items_summary"]], label=r["month"], zone=zone, adapter=adapter)
        for r in found if r["month"] not in done]


def _manifest(spark, warehouse: Warehouse, adapter: SourceAdapter, files: dict[str, list[str]],
              batch_id: int) -> DataFrame:
    """Every supplied file with its role and checksum, staged: hashing reads all bytes."""
    parts = [adapter.manifest(spark, paths).withColumn("role", F.lit(role))
             for role, paths in files.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return warehouse.staged(whole, batch_id, "manifest")


def _reject_known(warehouse: Warehouse, manifest: DataFrame) -> None:
    known = warehouse.import_files().select(F.col("file_checksum").alias("checksum"))
    again = manifest.join(known, "checksum", "left_semi").take(REPORTED)
    if again:
        raise ImportRejected("already imported: " + ", ".join(
            f"{r['role']} file {r['name']}" for r in again))
    twice = manifest.groupBy("checksum").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter("n > 1").take(REPORTED)
    if twice:
        raise ImportRejected("supplied twice: " + ", ".join(r["name"] for r in twice))


def _fail_if_any(problems: DataFrame, error: type[Exception], told, what: str) -> None:
    """Raise with the number of problem rows and a description of the first few."""
    first = problems.take(REPORTED)
    if first:
        raise error(f"{problems.count()} {what}: " + "; ".join(told(r) for r in first))


def _run(spark, warehouse, adapter, files, manifest, batch_id, label, zone):
    def read(role: str, reader) -> DataFrame:
        return reader(spark, files[role], manifest.filter(F.col("role") == role))

    source = adapter.source
    summary = read("items_summary", adapter.summary) if "items_summary" in files else None
    parsed = warehouse.staged(
        read("transactions", adapter.transactions), batch_id, "transactions")
    items = warehouse.staged(read("items_detail", adapter.items), batch_id, "items")

    # --- channels ---------------------------------------------------------------------
    served, _ = ingest.zero_value_payments(parsed, items)
    _fail_if_any(
        served.filter(F.col("own_channel").isNull()), UnresolvedChannel,
        lambda r: f"transaction {r['source_order_id']}: {r['reason']}",
        "payment(s) of nothing with item lines have no channel")
    places = exports.row_number_offsets(parsed)
    _fail_if_any(
        exports.with_row_numbers(ingest.unresolved_payments(parsed), places), UnresolvedChannel,
        lambda r: f"row {r['row_number']} (transaction {r['source_order_id']}): {r['message']}",
        "payment(s) have no channel")

    # --- orders against themselves and the stored ones ------------------------------------
    lines = ingest.sound(items)
    built = warehouse.staged(
        ingest.with_line_digest(
            ingest.build_orders(parsed, items, source)
            .withColumn("local_month", local_month(F.col("occurred_at"), zone)),
            lines.withColumn("source", F.lit(source))),
        batch_id, "orders")
    _fail_if_any(
        ingest.repeated_keys(built), RepeatedOrder,
        lambda r: f"{r['source_order_id']} ({r['n']} times)", "order id(s) repeat")
    compared = warehouse.staged(_compared(warehouse, built), batch_id, "compared")
    _fail_if_any(
        compared.filter(F.size("differences") > 0), ConflictingOrder,
        lambda r: f"{r['source_order_id']}: " + ", ".join(r["differences"]),
        "order(s) are stored with different content")
    known = compared.select("source_order_id")
    kept = warehouse.staged(
        built.join(known, "source_order_id", "left_anti"), batch_id, "kept")
    kept_lines = lines.join(kept.select("source_order_id", "local_month"), "source_order_id")

    reconciled = None if summary is None else _reconcile(kept, kept_lines, summary)

    # --- writes, invisible until the batch row ----------------------------------------------
    catalogue = warehouse.products().select("product_id", "name", "variation")
    fresh = warehouse.staged(ingest.new_products(kept_lines, catalogue), batch_id, "products")
    top = warehouse.products().agg(F.max("product_id")).first()[0] or 0
    warehouse.append(
        warehouse.numbered(fresh, "product_id", top), "products", batch_id)
    top = warehouse.orders().agg(F.max("order_id")).first()[0] or 0
    warehouse.append(
        warehouse.numbered(kept, "order_id", top).drop(*exports.ROW_KEYS),
        "orders", batch_id, "local_month")
    warehouse.append(
        daily.day_totals(warehouse.written("orders", batch_id), zone, "channel").withColumn(
            "zone", F.lit(zone)), "day_totals", batch_id, "zone")
    _append_items(warehouse, batch_id, kept_lines, catalogue)

    issues = _all_issues(parsed, items, built, compared)
    warehouse.append(issues, "issues", batch_id)
    _append_files(warehouse, batch_id, manifest, summary, parsed, items, kept, kept_lines)
    outcome = _commit(warehouse, batch_id, label, zone, kept_lines, fresh, reconciled)
    warehouse.clear_staging(batch_id)
    return outcome


def _compared(warehouse: Warehouse, built: DataFrame) -> DataFrame:
    """Incoming orders against stored ones, by their fields and line digests.

    Orders stored without a digest get it from their lines, of which only those orders'
    months are read.
    """
    stored = warehouse.orders().join(
        built.select(*ingest.ORDER_KEY), ingest.ORDER_KEY, "left_semi")
    old = stored.filter("line_digest is null")
    months = [r["local_month"] for r in old.select("local_month").distinct().collect()]
    if months:
        lines = (
            stored_lines(warehouse, months)
            .join(old.select("order_id", *ingest.ORDER_KEY), "order_id")
        )
        stored = stored.filter("line_digest is not null").unionByName(
            ingest.with_line_digest(old.drop("line_digest"), lines))
    return ingest.compare_orders(built, stored)


def stored_lines(warehouse: Warehouse, months: list[str]) -> DataFrame:
    """Lines of orders of some months, with the names of their products."""
    return warehouse.order_items().filter(F.col("local_month").isin(months)).select(
        "order_id", "product_id", "quantity", "unit_price", "line_total", "discount_amount"
    ).join(warehouse.products().select("product_id", "name", "variation"), "product_id")


def _reconcile(orders: DataFrame, lines: DataFrame, summary: DataFrame) -> dict[str, int] | None:
    """Both sides' totals, equal; None for a summary without rows."""
    row = ingest.reconciliation(orders, lines, summary).first()
    if row["summary_rows"] == 0:
        return None
    if row["unreadable_rows"]:
        raise SourceFormatError(f"{row['unreadable_rows']} summary row(s) cannot be read")
    if not row["matches"]:
        told = "; ".join(f"{c} ours={row[c + '_ours']} theirs={row[c + '_theirs']}"
                         for c in ("net_sales", "line_totals", "units"))
        raise ReconciliationFailed(
            f"totals differ from the items summary: {told}. Orders already imported from an "
            "overlapping extraction are not counted on our side.")
    return {f"{c}_{side}": row[f"{c}_{side}"]
            for c in ("net_sales", "line_totals", "units") for side in ("ours", "theirs")}


def _append_items(warehouse: Warehouse, batch_id: int, lines: DataFrame,
                  catalogue: DataFrame) -> None:
    """Lines with their order and product ids, partitioned like their orders."""
    orders = warehouse.written("orders", batch_id)
    added = warehouse.written("products", batch_id)
    products = catalogue.unionByName(added.select("product_id", "name", "variation"))
    resolved = lines.join(
        orders.select("order_id", "source_order_id"), "source_order_id"
    ).join(products, ["name", "variation"])
    warehouse.append(
        resolved.select("order_id", "product_id", "quantity", "unit_price", "line_total",
                        "discount_amount", "local_month"),
        "order_items", batch_id, "local_month")


def _all_issues(parsed, items, built, compared) -> DataFrame:
    on_rows = exports.with_row_numbers(
        ingest.transaction_issues(parsed, items), exports.row_number_offsets(parsed))
    on_items = exports.with_row_numbers(
        ingest.row_issues(items), exports.row_number_offsets(items))
    fields = ingest.ISSUE_FIELDS
    return (
        on_rows.select(*fields).unionByName(on_items.select(*fields))
        .unionByName(ingest.orphan_issues(items, built).select(*fields))
        .unionByName(ingest.duplicate_issues(compared).select(*fields))
    )


def _append_files(warehouse, batch_id, manifest, summary, parsed, items, kept, lines) -> None:
    """Per file: rows read, rows that became orders or lines, and the rest."""
    def per_file(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("_file").agg(F.count(F.lit(1)).alias(name))

    read = per_file(parsed, "row_count").unionByName(per_file(items, "row_count"))
    if summary is not None:
        read = read.unionByName(per_file(summary, "row_count"))
    used = per_file(kept, "rows_imported").unionByName(per_file(lines, "rows_imported"))
    # The scan and the listing spell a path's scheme differently; the name part agrees.
    tail = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    counted = read.join(used, "_file", "left").select(
        F.regexp_replace("_file", r"^[a-z0-9]+:/*", "").alias("tail"), "row_count",
        F.coalesce("rows_imported", F.lit(0)).cast("bigint").alias("rows_imported"))
    rows = manifest.withColumn("tail", tail).join(counted, "tail", "left")
    read_rows = F.coalesce("row_count", F.lit(0)).cast("bigint")
    used_rows = F.coalesce("rows_imported", F.lit(0)).cast("bigint")
    warehouse.append(rows.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), "role", F.col("name").alias("filename"),
        F.col("checksum").alias("file_checksum"), read_rows.alias("row_count"),
        used_rows.alias("rows_imported"), (read_rows - used_rows).alias("rows_skipped"),
    ), "import_files", batch_id)


def _commit(warehouse, batch_id, label, zone, lines, fresh, reconciled) -> ImportOutcome:
    """Totals from the written tables, then the row that makes the batch visible."""
    day = local_day(F.col("occurred_at"), zone)
    totals = warehouse.written("orders", batch_id).agg(
        F.count(F.lit(1)).alias("orders"), F.min(day).alias("start"), F.max(day).alias("end"),
        F.coalesce(F.sum("net_amount"), F.lit(0)).alias("net")).first()
    counts = ingest.issue_counts(warehouse.written("issues", batch_id)).collect()
    created = fresh.count()
    used = lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("name", "variation").alias("products")).first()
    log = "; ".join(f"{r['code']}: {r['issues']}" for r in sorted(counts, key=lambda r: r["code"]))
    warehouse.append_batch((batch_id, label, totals["start"], totals["end"], "completed", _now(),
                            log or None))
    return ImportOutcome(
        batch_id, label, totals["start"], totals["end"], totals["orders"], used["lines"],
        created, used["products"] - created,
        sum(r["issues"] for r in counts if r["severity"] == SKIP), totals["net"],
        reconciled is not None, {r["code"]: r["issues"] for r in counts}, reconciled)
