"""Day totals kept by imports, against recomputation from all stored orders."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.clock import period
from tallyhouse.operators import daily, series
from tallyhouse.operators.orders import revenue_series
from tests.conftest import item, tx
from tests.test_import_job import run, warehouse  # noqa: F401

AUGUST = period(date(2026, 8, 1), date(2026, 8, 31))


def cells(day, number, amount, **more):
    return tx(Transaction_ID=number, Date=day, Net_Sales=amount, **more)


def imported(run):  # noqa: F811
    """Two extractions that share the orders of the 15th, on two channels."""
    shared = [cells("2026-08-15", "B", "£4.20"), cells("2026-08-15", "C", "£3.00")]
    first = [cells("2026-08-14", "A", "£1.50"), *shared]
    second = [*shared, cells("2026-08-15", "D", "£2.00", Source="Uber Eats", Dining_Option=""),
              cells("2026-08-18", "E", "£7.00"),
              cells("2026-08-18", "F", "-£1.00", Event_Type="Refund", Payment_ID="PAY-9")]
    for tag, rows in (("1", first), ("2", second)):
        run(rows, [item(Transaction_ID=r["Transaction ID"], Date=r["Date"],
                        Product_Sales=r["Net Sales"]) for r in rows], tag=tag)


def plain(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_merged_days_equal_recomputation_after_overlapping_imports(run, warehouse):  # noqa: F811
    imported(run)
    kept = warehouse.day_totals()
    again = daily.day_totals(warehouse.orders(), AUGUST.zone, "channel")
    assert plain(kept) == plain(again.select(kept.columns)) and kept.count() == 4
    for granularity in ("day", "week"):
        assert plain(daily.revenue_of_days(kept, AUGUST, granularity)) == plain(
            revenue_series(warehouse.orders(), AUGUST, granularity))
    days = daily.merged(kept.withColumn("series_id", F.lit("all")), "series_id", "day")
    filled = series.filled_series(days.select("series_id", "day", *series.TARGETS))
    assert plain(filled) == plain(series.daily_series(warehouse.orders()))


def test_orders_are_read_only_of_batches_without_totals(run, warehouse, spark):  # noqa: F811
    imported(run)
    plan = warehouse.day_totals()._jdf.queryExecution().toString()
    assert "occurred_at" not in plan
    # Another zone has no totals yet, so every batch is summed from its orders.
    other = warehouse.day_totals("America/New_York")
    assert "occurred_at" in other._jdf.queryExecution().toString()
    again = daily.day_totals(warehouse.orders(), "America/New_York", "channel")
    assert plain(other) == plain(again.select(other.columns))
    # As if the first batch was imported before totals were kept.
    folder = warehouse.path("day_totals", "import_batch_id=1")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    partly = warehouse.day_totals()
    assert plain(partly) == plain(
        daily.day_totals(warehouse.orders(), AUGUST.zone, "channel").select(partly.columns))
    assert "import_batch_id#" in partly._jdf.queryExecution().toString()


def test_a_failed_import_adds_nothing(run, warehouse):  # noqa: F811
    assert warehouse.day_totals().count() == 0
    with pytest.raises(Exception):
        run([tx(Transaction_ID="A", Source="Nowhere", Dining_Option="")], [item(Transaction_ID="A")])
    assert warehouse.day_totals().count() == 0


def test_granularity_is_checked(warehouse):  # noqa: F811
    with pytest.raises(ValueError, match="granularity"):
        daily.revenue_of_days(warehouse.day_totals(), AUGUST, "year")
