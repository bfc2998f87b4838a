"""Imports end to end: from files to committed tables, and every way to be refused."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse import schemas
from tallyhouse.operators import ingest
from tallyhouse.plans import import_job as job
from tallyhouse.sources import exports
from tallyhouse.sources.adapters import SourceAdapter
from tallyhouse.sources.warehouse import ImportInProgress, Warehouse
from tests.conftest import (
    ITEM_COLUMNS, SUMMARY_COLUMNS, TX_COLUMNS, item, summary, tx, write_export,
)


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


@pytest.fixture
def run(spark, warehouse, export_dir):
    def go(transactions, items, totals=None, tag="1", **how):
        return job.import_exports(
            spark, warehouse, **export_dir(transactions, items, totals, tag), **how)
    return go


SAMPLE_TX = [
    tx(Transaction_ID="T1", Payment_ID="P1", Net_Sales="£8.40"),
    tx(Transaction_ID="T2", Payment_ID="P2", Net_Sales="£4.20", Dining_Option="Takeaway"),
    tx(Transaction_ID="T3", Payment_ID="P3", Net_Sales="£9.00", Source="Uber Eats",
       Dining_Option=""),
    tx(Transaction_ID="T4", Payment_ID="P4", Net_Sales="£8.00",
       Dining_Option="Eat In, Takeaway"),
    tx(Transaction_ID="T5", Payment_ID="P5", Net_Sales="£5.00", Source="Square Online",
       Dining_Option=""),
    tx(Transaction_ID="T6", Payment_ID="P6", Net_Sales="£20.00", Source="Deliveroo Pickup"),
    tx(Transaction_ID="T7", Payment_ID="P7", Net_Sales="£3.20", Discounts="-£1.00"),
    # A refund rung at the till inherits the delivery channel of its payment.
    tx(Transaction_ID="T8", Payment_ID="P3", Net_Sales="-£9.00", Event_Type="Refund",
       Dining_Option=""),
    tx(Transaction_ID="T9", Payment_ID="P9", Net_Sales="£0.00"),
]
SAMPLE_ITEMS = [
    item(Transaction_ID="T1", Qty="2.0", Product_Sales="£8.40"),
    item(Transaction_ID="T2"),
    item(Transaction_ID="T3", Item="Brunch", Price_Point_Name="", Product_Sales="£9.00"),
    item(Transaction_ID="T4", Item="Cake", Product_Sales="£8.00", Category="None"),
    item(Transaction_ID="T5", Item="Custom Amount", Price_Point_Name="",
         Product_Sales="£5.00"),
    item(Transaction_ID="T6", Item="Gift Voucher", Price_Point_Name="",
         Product_Sales="£20.00"),
    item(Transaction_ID="T7", Discounts="-£1.00"),
    item(Transaction_ID="T8", Item="Brunch", Price_Point_Name="", Qty="-1.0",
         Product_Sales="-£9.00"),
]
SAMPLE_SUMMARY = [
    summary(Units_Sold="4.0", Product_Sales="£16.80", Net_Sales="£15.80"),
    summary(Item_Name="Brunch", Units_Sold="1", Items_Refunded="-1", Product_Sales="£9.00",
            Refunds="-£9.00", Net_Sales="£0.00"),
    summary(Item_Name="Cake", Product_Sales="£8.00", Net_Sales="£8.00"),
    summary(Item_Name="Custom Amount", Product_Sales="£5.00", Net_Sales="£5.00"),
    summary(Item_Name="Gift Voucher", Product_Sales="£20.00", Net_Sales="£20.00"),
]


def test_sample_reconciles_and_is_stored(run, warehouse):
    outcome = run(SAMPLE_TX, SAMPLE_ITEMS, SAMPLE_SUMMARY, label="August")
    assert outcome.reconciled
    assert (outcome.orders_created, outcome.order_items_created) == (8, 8)
    assert (outcome.products_created, outcome.products_reused) == (5, 0)
    assert outcome.net_sales_pence == 4880
    assert outcome.rows_skipped == 1
    assert outcome.issue_counts == {"zero_value_transaction": 1, "refund_channel_inherited": 1}
    assert (outcome.period_start, outcome.period_end) == (date(2026, 8, 15),) * 2

    orders = {r["source_order_id"]: r for r in warehouse.orders().collect()}
    assert {k: r["channel"] for k, r in orders.items()} == {
        "T1": "in_store", "T2": "in_store", "T3": "delivery", "T4": "mixed", "T5": "online",
        "T6": "collection", "T7": "in_store", "T8": "delivery"}
    assert orders["T7"]["gross_amount"] == 420 and orders["T7"]["discount_amount"] == 100
    assert orders["T1"]["occurred_at"] == datetime(2026, 8, 15, 11, 30)
    assert orders["T1"]["item_count"] == 2 and orders["T8"]["item_count"] == -1
    assert all(r["gross_amount"] - r["discount_amount"] == r["net_amount"]
               for r in orders.values())
    assert sorted(r["order_id"] for r in orders.values()) == list(range(1, 9))
    assert {r["local_month"] for r in orders.values()} == {"2026-08"}

    products = {r["name"]: r for r in warehouse.products().collect()}
    assert products["Gift Voucher"]["kind"] == "gift_voucher"
    assert products["Custom Amount"]["kind"] == "custom_amount"
    assert products["Cake"]["category"] is None and products["Brunch"]["variation"] == ""
    lines = warehouse.order_items().collect()
    assert {r["order_id"] for r in lines} == {r["order_id"] for r in orders.values()}
    first = [r for r in lines if r["order_id"] == orders["T1"]["order_id"]][0]
    assert (first["unit_price"], first["product_id"]) == (
        420, products["Ginger Tea"]["product_id"])

    files = {r["role"]: r for r in warehouse.import_files().collect()}
    assert [(files[r]["row_count"], files[r]["rows_imported"], files[r]["rows_skipped"])
            for r in ("transactions", "items_detail", "items_summary")] == [
        (9, 8, 1), (8, 8, 0), (5, 0, 5)]
    batch = warehouse.import_batches().collect()
    assert [(b["status"], b["label"]) for b in batch] == [("completed", "August")]


def test_same_file_is_rejected_before_anything_starts(run, warehouse):
    run([tx()], [item()])
    with pytest.raises(job.ImportRejected, match="transactions file transactions-1"):
        run([tx()], [item(), item()])
    assert warehouse.import_batches().count() == 1


def test_one_file_in_two_roles_is_rejected(spark, warehouse, tmp_path):
    path = write_export(tmp_path / "t.csv", TX_COLUMNS, [tx()])
    with pytest.raises(job.ImportRejected, match="twice"):
        job.import_exports(spark, warehouse, [path], [path])


def test_overlap_skips_identical_orders_and_reuses_products(run, warehouse):
    run([tx(Transaction_ID="A", Net_Sales="£4.20")],
        [item(Transaction_ID="A"), item(Transaction_ID="A", Item="Cake")], tag="1")
    # The same order comes again with its lines in another sequence, next to a new one.
    again = run(
        [tx(Transaction_ID="A", Net_Sales="£4.20"), tx(Transaction_ID="B", Net_Sales="£4.20")],
        [item(Transaction_ID="A", Item="Cake"), item(Transaction_ID="A"),
         item(Transaction_ID="B")], tag="2")
    assert again.orders_created == 1 and again.issue_counts == {"duplicate_order": 1}
    assert (again.products_created, again.products_reused) == (0, 1)
    stored = warehouse.orders().collect()
    assert sorted((r["order_id"], r["source_order_id"]) for r in stored) == [(1, "A"), (2, "B")]
    assert warehouse.order_items().count() == 3


def test_changed_order_conflicts(run, warehouse):
    run([tx(Net_Sales="£4.20")], [item()], tag="1")
    with pytest.raises(job.ConflictingOrder, match="net_amount incoming=400 stored=420"):
        run([tx(Net_Sales="£4.00"), tx(Transaction_ID="NEW")],
            [item(), item(Transaction_ID="NEW")], tag="2")
    assert [r["source_order_id"] for r in warehouse.orders().collect()] == ["TX-1"]
    assert sorted(r["status"] for r in warehouse.import_batches().collect()) == [
        "completed", "failed"]


def test_failed_import_can_be_repeated_after_a_fix(run, warehouse):
    rows, lines = [tx(Net_Sales="£4.20")], [item()]
    with pytest.raises(job.ReconciliationFailed, match="units ours=1 theirs=2"):
        run(rows, lines, [summary(Units_Sold="2")])
    assert warehouse.orders().isEmpty() and warehouse.import_files().isEmpty()
    log = warehouse.import_batches().first()["error_log"]
    assert log.startswith("ReconciliationFailed") and "transactions-1.csv" in log
    assert run(rows, lines, [summary()]).reconciled


def test_unknown_channel_stops_the_import(run, warehouse):
    with pytest.raises(job.UnresolvedChannel, match=r"row 3 \(transaction T2\).*Kiosk"):
        run([tx(), tx(Transaction_ID="T2", Source="Kiosk")], [item()])
    assert warehouse.orders().isEmpty()


def test_zero_value_payment_with_items_is_an_order(run, warehouse):
    outcome = run([tx(Transaction_ID="W", Net_Sales="£0.00")],
                  [item(Transaction_ID="W", Item="Tap Water", Product_Sales="£0.00")])
    assert outcome.issue_counts == {"zero_value_order_retained": 1}
    assert outcome.rows_skipped == 0 and outcome.orders_created == 1
    assert warehouse.orders().first()["item_count"] == 1


def test_zero_value_payment_with_items_needs_a_channel(run):
    with pytest.raises(job.UnresolvedChannel, match="transaction W"):
        run([tx(Transaction_ID="W", Net_Sales="£0.00", Source="Kiosk")],
            [item(Transaction_ID="W")])


def test_zero_value_without_items_may_lack_a_channel(run):
    outcome = run([tx(), tx(Transaction_ID="W", Net_Sales="£0.00", Source="Kiosk")], [item()])
    assert outcome.issue_counts == {"zero_value_transaction": 1}


def test_repeated_order_id_in_one_file(run):
    with pytest.raises(job.RepeatedOrder, match="TX-1"):
        run([tx(), tx()], [item()])


def test_orphans_are_reported_and_dropped(run, warehouse):
    outcome = run([tx()], [item(), item(Transaction_ID="GONE"), item(Transaction_ID="GONE")])
    assert outcome.issue_counts == {"orphan_item": 1} and outcome.order_items_created == 1
    issue = warehouse.issues().first()
    assert (issue["row_number"], issue["source_order_id"]) == (0, "GONE")
    assert issue["message"].startswith("2 item row")


def test_every_bad_row_is_reported_with_its_row_number(run, warehouse):
    outcome = run(
        [tx(), tx(Transaction_ID=" "), tx(Transaction_ID="B", Event_Type="Void"),
         tx(Transaction_ID="C", Time_Zone="Paris"), tx(Transaction_ID="D", Date="soon"),
         tx(Transaction_ID="E", Date="2026-03-29", Time="01:30:00"),
         tx(Transaction_ID="F", Net_Sales="£1.005"),
         tx(Transaction_ID="G", Date="2026-10-25", Time="01:30:00"),
         tx(Transaction_ID="H", Event_Type="Refund", Payment_ID="", Net_Sales="-£1.00"),
         tx(Transaction_ID="I", Event_Type="Refund", Payment_ID="?", Net_Sales="-£1.00",
            Source="Kiosk")],
        [item(), item(Transaction_ID=""), item(Qty="1.5"), item(Product_Sales="x"),
         item(Qty="0")])
    found = sorted((r["row_number"], r["code"], r["severity"])
                   for r in warehouse.issues().collect())
    assert found == sorted([
        (3, "missing_transaction_id", "skip"), (4, "unknown_event_type", "skip"),
        (5, "unknown_time_zone", "skip"), (6, "unparsable_timestamp", "skip"),
        (7, "nonexistent_local_time", "skip"), (8, "unparsable_money", "skip"),
        (9, "ambiguous_local_time", "warn"), (10, "refund_channel_derived", "warn"),
        (11, "refund_channel_unknown", "warn"),
        (3, "missing_transaction_id", "skip"), (4, "unparsable_quantity", "skip"),
        (5, "unparsable_money", "skip"), (6, "unparsable_quantity", "skip")])
    assert outcome.rows_skipped == 10 and outcome.orders_created == 4
    assert {code for _, code, _ in found} <= set(schemas.ISSUE_CODES)
    stored = warehouse.orders().select("channel", "event_type").collect()
    assert {r["channel"] for r in stored} <= set(schemas.CHANNELS)
    assert {r["event_type"] for r in stored} <= set(schemas.EVENT_TYPES)


def test_coverage_is_in_local_days(run):
    outcome = run([tx(Date="2026-08-01", Time="00:30:00")], [item()])
    assert outcome.period_start == date(2026, 8, 1)


def test_known_product_keeps_its_kind(run, warehouse):
    run([tx()], [item(Category="Hot drinks")], tag="1")
    run([tx(Transaction_ID="T2")], [item(Transaction_ID="T2", Category="Tea")], tag="2")
    assert [r["category"] for r in warehouse.products().collect()] == ["Hot drinks"]


def test_many_files_of_a_role_are_one_extraction(spark, warehouse, tmp_path, export_dir):
    a = export_dir([tx(Transaction_ID="A")], [item(Transaction_ID="A")], tag="a")
    b = export_dir([tx(Transaction_ID="B")], [item(Transaction_ID="B"), item()], tag="b")
    outcome = job.import_exports(spark, warehouse, a["transactions"] + b["transactions"],
                                 a["items"] + b["items"])
    assert outcome.orders_created == 2 and outcome.order_items_created == 2
    rows = {r["filename"]: (r["row_count"], r["rows_imported"])
            for r in warehouse.import_files().collect()}
    assert rows == {"transactions-a.csv": (1, 1), "transactions-b.csv": (1, 1),
                    "items-a.csv": (1, 1), "items-b.csv": (2, 1)}


def test_summary_of_our_own_lines_reconciles(run, warehouse, spark):
    run(SAMPLE_TX, SAMPLE_ITEMS)
    lines = warehouse.order_items().join(
        warehouse.products().select("product_id", "name", "variation"), "product_id")
    ours = ingest.summarise_lines(lines)
    totals = ours.agg(F.sum("net_sales"), F.sum(F.col("items_sold") + F.col("items_refunded")),
                      F.sum(F.col("product_sales") + F.col("refunds"))).first()
    assert tuple(totals) == (4880, 7, 4980)


def test_wrong_file_fails_with_a_record(spark, warehouse, tmp_path, export_dir):
    good = export_dir([tx()], [item()])
    with pytest.raises(exports.SourceSchemaError):
        job.import_exports(spark, warehouse, good["items"], good["transactions"])
    assert [r["status"] for r in warehouse.import_batches().collect()] == ["failed"]


# --- the steps on their own ----------------------------------------------------------------


def extraction(spark, transactions, items):
    """Parsed transactions and items in the order given."""
    def frame(rows, columns):
        keyed = [("f", 0, i, *[row[c] for c in columns]) for i, row in enumerate(rows)]
        names = ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame(keyed, f"_file string, _split long, _seq long, {names}")

    return (ingest.parse_transactions(frame(transactions, exports.BOUND["transactions"])),
            ingest.parse_items(frame(items, exports.BOUND["items_detail"])))


def orders_of(spark, transactions, items):
    built = ingest.build_orders(*extraction(spark, transactions, items), "till")
    return {r["source_order_id"]: r for r in built.collect()}


def test_last_payment_of_an_id_lends_its_channel(spark):
    refund = tx(Transaction_ID="R", Payment_ID="P", Event_Type="Refund", Net_Sales="-£1.00")
    a = tx(Transaction_ID="A", Payment_ID="P")
    b = tx(Transaction_ID="B", Payment_ID="P", Source="Deliveroo")
    for rows, channel in (([a, b, refund], "delivery"), ([refund, b, a], "in_store"),
                          ([refund, b], "delivery")):
        assert orders_of(spark, rows, [item()])["R"]["channel"] == channel


def test_zero_value_payment_lends_no_channel(spark):
    rows = [tx(Transaction_ID="W", Payment_ID="P", Net_Sales="£0.00", Source="Deliveroo"),
            tx(Transaction_ID="R", Payment_ID="P", Event_Type="Refund", Net_Sales="-£1.00",
               Source="Kiosk")]
    got = orders_of(spark, rows, [item(Transaction_ID="W")])
    assert (got["W"]["channel"], got["R"]["channel"]) == ("delivery", "unknown")


def test_refund_of_nothing_is_kept(spark):
    rows = [tx(Transaction_ID="R", Event_Type="Refund", Net_Sales="£0.00")]
    assert orders_of(spark, rows, [item()])["R"]["net_amount"] == 0


def test_differences_are_told_per_field(spark):
    def order(order_id, net=420, count=1, payment="P"):
        return ("till", order_id, datetime(2026, 8, 15), "in_store", "payment", net, 0, net,
                count, payment)

    def line(order_id, name="Latte", total=420):
        return ("till", order_id, name, "Regular", 1, total, total, 0)

    columns = (*ingest.ORDER_KEY, *ingest.ORDER_FIELDS)
    fields = (*ingest.ORDER_KEY, *ingest.LINE_FIELDS)
    new = spark.createDataFrame(
        [order("same"), order("net", 400), order("lines"), order("copies", count=2),
         order("payment", payment=None), order("only new")], list(columns))
    old = spark.createDataFrame(
        [order("same"), order("net"), order("lines"), order("copies"), order("payment"),
         order("only old")], list(columns))
    new_lines = spark.createDataFrame(
        [line("same"), line("same", "Cake"), line("net"), line("lines", total=360),
         line("copies"), line("copies"), line("payment")], list(fields))
    old_lines = spark.createDataFrame(
        [line("same", "Cake"), line("same"), line("net"), line("lines"), line("copies"),
         line("payment")], list(fields))
    got = {r["source_order_id"]: r["differences"] for r in ingest.compare_with_stored(
        new, new_lines, old, old_lines).collect()}
    assert got == {
        "same": [], "net": ["gross_amount incoming=400 stored=420",
                            "net_amount incoming=400 stored=420"],
        "lines": ["line_items differ"],
        "copies": ["item_count incoming=2 stored=1", "line_items differ"],
        "payment": ["source_payment_id incoming=NULL stored=P"]}


def test_line_digests_tell_multisets_apart(spark):
    lines = spark.createDataFrame(
        [("till", "a", "Tea", "", 1, 5, 5, 0), ("till", "a", "Tea", "", 1, 5, 5, 0),
         ("till", "b", "Tea", "", 1, 5, 5, 0), ("till", "c", "Tea", "", 1, 5, 5, 0),
         ("till", "c", "Pie", "", 1, 5, 5, 0), ("till", "d", "Pie", "", 1, 5, 5, 0),
         ("till", "d", "Tea", "", 1, 5, 5, 0), ("till", "e", "", "Tea", 1, 5, 5, 0),
         ("till", "f", "Tea", "", 1, 5, None, 5), ("till", "g", "Tea", "", 1, 5, 5, None)],
        "source string, source_order_id string, name string, variation string, quantity int,"
        " unit_price int, line_total long, discount_amount long")
    got = {r["source_order_id"]: r["line_digest"] for r in ingest.line_digest(lines).collect()}
    assert got["c"] == got["d"] and len(set(got.values())) == 6


def test_redelivery_reads_no_stored_lines_and_old_orders_only_their_months(run, warehouse, spark):
    run([tx(Transaction_ID="A", Net_Sales="£4.20")], [item(Transaction_ID="A")], tag="1")
    run([tx(Transaction_ID="B", Date="2026-06-02")], [item(Transaction_ID="B", Date="2026-06-02")], tag="2")
    built = warehouse.orders().drop("order_id", "import_batch_id")
    assert all(r["line_digest"] for r in built.collect())
    plan = job._compared(warehouse, built)._jdf.queryExecution().toString()
    assert "order_items" not in plan
    lines = job.stored_lines(warehouse, ["2026-06"])
    assert lines.count() == 1
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "local_month" in plan.split("PartitionFilters: [")[1].split("]")[0]

    # Orders stored before digests were: the same rows without the column.
    for batch in (1, 2):
        plain = warehouse.written("orders", batch).drop("line_digest").collect()
        schema = warehouse.written("orders", batch).drop("line_digest").schema
        warehouse.append(spark.createDataFrame(plain, schema), "orders", batch, "local_month")
    assert {r["line_digest"] for r in warehouse.orders().collect()} == {None}
    again = run([tx(Transaction_ID="A", Net_Sales="£4.20"), tx(Transaction_ID="C")],
                [item(Transaction_ID="A"), item(Transaction_ID="C")], tag="3")
    assert again.orders_created == 1 and again.issue_counts == {"duplicate_order": 1}
    with pytest.raises(job.ConflictingOrder, match="A: line_items differ"):
        run([tx(Transaction_ID="A", Net_Sales="£4.20"), tx(Transaction_ID="D")],
            [item(Transaction_ID="A", Item="Cake"), item(Transaction_ID="D")], tag="4")


def test_second_import_at_the_same_time_is_refused(run, warehouse):
    claimed = warehouse.claim_batch()
    with pytest.raises(ImportInProgress, match="batch 1 is not finished"):
        run([tx()], [item()])
    assert warehouse.import_batches().isEmpty() and warehouse.orders().isEmpty()
    warehouse.abandon_batch(claimed)
    assert run([tx()], [item()]).batch_id == 2
    assert sorted(r["status"] for r in warehouse.import_batches().collect()) == ["completed", "failed"]


def test_of_two_claims_made_together_one_fails(warehouse, monkeypatch):
    monkeypatch.setattr(Warehouse, "_claims", lambda self: set())  # both listed before either claimed
    assert warehouse.claim_batch() == 1
    with pytest.raises(ImportInProgress, match="claimed just now"):
        warehouse.claim_batch()


def test_numbering_does_not_shuffle_the_table(spark, warehouse):
    staged = warehouse.staged(spark.range(1000).repartition(7), 1, "numbers")
    numbered = warehouse.numbered(staged, "n", 40)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(41, 1041))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


# --- other formats and whole folders -----------------------------------------------------


class JsonTickets(SourceAdapter):
    """A second format: one JSON object a line, amounts in whole pence, one instant in UTC."""

    source = "kiosk"

    def manifest(self, spark, paths):
        files = spark.read.format("binaryFile").load(paths)
        return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                            "length", F.sha2("content", 256).alias("checksum"))

    def _cells(self, spark, paths, schema, names):
        def pounds(column):
            sign = F.when(F.col(column) < 0, "-").otherwise("")
            return F.concat(sign, F.lit("£"), F.format_string(
                "%d.%02d", F.floor(F.abs(F.col(column)) / 100), F.abs(F.col(column)) % 100))

        rows = spark.read.schema(schema).json(paths).select(*exports.row_keys(), "*")
        given = {name: pounds(c) if name.endswith("Sales") else F.col(c) for name, c in names.items()}
        usual = {"Date": F.substring("at", 1, 10), "Time": F.substring("at", 12, 8),
                 "Time Zone": F.lit("London"), "Event Type": F.lit("Payment"),
                 "Discounts": F.lit("£0.00"), "Source": F.lit("Register"),
                 "Dining Option": F.lit("Eat in"), "Category": F.lit("None"),
                 "Price Point Name": F.lit(""), "Modifiers Applied": F.lit("")}
        return rows.select(*exports.ROW_KEYS, *[c.alias(n) for n, c in (usual | given).items()])

    def transactions(self, spark, paths, manifest):
        return ingest.parse_transactions(self._cells(
            spark, paths, "ticket string, at string, paid long",
            {"Transaction ID": "ticket", "Payment ID": "ticket", "Net Sales": "paid"}))

    def items(self, spark, paths, manifest):
        return ingest.parse_items(self._cells(
            spark, paths, "ticket string, at string, dish string, n string, cost long",
            {"Transaction ID": "ticket", "Item": "dish", "Qty": "n", "Product Sales": "cost"}))

    def summary(self, spark, paths, manifest):
        raise NotImplementedError


def test_another_format_is_imported_through_its_adapter(spark, run, warehouse, tmp_path):
    run([tx(Transaction_ID="K1", Net_Sales="£4.20")], [item(Transaction_ID="K1")])
    tickets, dishes = tmp_path / "tickets.json", tmp_path / "dishes.json"
    tickets.write_text('{"ticket": "K1", "at": "2026-08-15T09:00:00", "paid": 1250}\n')
    dishes.write_text(
        '{"ticket": "K1", "at": "2026-08-15T09:00:00", "dish": "Soup", "n": "2", "cost": 1000}\n'
        '{"ticket": "K1", "at": "2026-08-15T09:00:00", "dish": "Bread", "n": "0", "cost": 1}\n'
        '{"ticket": "K1", "at": "2026-08-15T09:00:00", "dish": "Tea", "n": "1", "cost": 250}\n')
    outcome = job.import_exports(spark, warehouse, [str(tickets)], [str(dishes)],
                                 adapter=JsonTickets())
    # The same order id of another source is another order.
    assert (outcome.orders_created, outcome.order_items_created) == (1, 2)
    assert not outcome.reconciled and outcome.reconciliation is None
    stored = {r["source"]: r["net_amount"] for r in warehouse.orders().collect()}
    assert stored == {"till": 420, "kiosk": 1250}
    skipped = warehouse.issues().filter(F.col("import_batch_id") == 2).collect()
    # A JSON file has no header line, yet numbers follow the exports': its first row is row 2.
    assert [(r["code"], r["row_number"]) for r in skipped] == [("unparsable_quantity", 3)]


def _month(folder, month, amount, total):
    name = f"M{month}"
    write_export(folder / f"transactions-{month}.csv", TX_COLUMNS, [
        tx(Transaction_ID=name, Date=f"{month}-10", Net_Sales=amount)])
    write_export(folder / f"items-{month}.csv", ITEM_COLUMNS, [
        item(Transaction_ID=name, Date=f"{month}-10", Product_Sales=amount)])
    write_export(folder / f"item-sales-summary-{month}.csv", SUMMARY_COLUMNS, [
        summary(Item_Name="Ginger Tea", Product_Sales=total, Net_Sales=total)])


def test_a_folder_is_imported_month_by_month_and_taken_up_again(spark, warehouse, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    _month(folder, "2026-02", "£5.20", "£5.20")
    _month(folder, "2026-01", "£4.20", "£4.20")
    _month(folder, "2026-03", "£9.99", "£4.30")
    with pytest.raises(job.ReconciliationFailed):
        job.import_folder(spark, warehouse, str(folder))
    done = warehouse.import_batches().orderBy("batch_id").collect()
    assert [(b["label"], b["status"]) for b in done] == [
        ("2026-01", "completed"), ("2026-02", "completed"), ("2026-03", "failed")]
    with pytest.raises(job.ImportRejected):
        job.import_folder(spark, warehouse, str(folder))
    _month(folder, "2026-03", "£4.30", "£4.30")
    again = job.import_folder(spark, warehouse, str(folder), resume=True)
    assert [o.label for o in again] == ["2026-03"] and again[0].products_created == 0
    assert again[0].reconciliation == {
        "net_sales_ours": 430, "net_sales_theirs": 430, "line_totals_ours": 430,
        "line_totals_theirs": 430, "units_ours": 1, "units_theirs": 1}
    assert warehouse.orders().count() == 3
