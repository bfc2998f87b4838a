"""Order-level operators with answers worked out by hand, and their agreement."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.clock import period
from tallyhouse.operators import orders as ops
from tallyhouse.operators import products, results

AUGUST = period(date(2026, 8, 1), date(2026, 8, 31))


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


@pytest.fixture
def august(shop):
    """Nine orders of every kind, on local days around the month's edges."""
    latte, cake = shop.product("Latte"), shop.product("Cake")
    shop.order("2026-08-01 00:30", lines=[(latte, 2, 730)], channel="in_store")
    shop.order("2026-08-03 09:10", lines=[(latte, 1, 365, 65)], channel="in_store")
    shop.order("2026-08-03 09:50", lines=[(latte, 1, 365), (cake, 1, 400)], channel="mixed")
    shop.order("2026-08-04 12:00", lines=[(cake, 2, 800)], channel="delivery")
    shop.order("2026-08-09 18:00", lines=[(cake, 1, 400)], channel="online")
    shop.order("2026-08-10 09:30", lines=[(latte, 1, 365)], channel="collection")
    shop.order("2026-08-12 15:00", lines=[(cake, -1, -400)], channel="delivery", event="refund")
    shop.order("2026-08-31 23:59", lines=[(latte, 1, 365)], channel="in_store")
    shop.order("2026-08-20 11:00", net=0, units=0, channel="unknown")
    shop.order("2026-07-31 23:59", lines=[(latte, 9, 3285)])
    shop.order("2026-09-01 00:00", lines=[(latte, 9, 3285)])
    return shop


def test_overview(august):
    row = ops.overview(august.orders, AUGUST).first()
    assert row.asDict() == {
        "net_sales_pence": 3325, "gross_sales_pence": 3390, "discounts_pence": 65,
        "payment_order_count": 8, "refund_event_count": 1, "net_units": 9,
        "average_order_value_pence": 416}


def test_five_views_agree(august):
    whole = ops.overview(august.orders, AUGUST).first()
    for view in (
        ops.revenue_series(august.orders, AUGUST, "day"),
        ops.revenue_series(august.orders, AUGUST, "week"),
        ops.day_of_week(august.orders, AUGUST), ops.peak_hours(august.orders, AUGUST),
        ops.channel_mix(august.orders, AUGUST),
    ):
        assert tuple(ops.series_totals(view).first()) == (
            whole["net_sales_pence"], whole["payment_order_count"], whole["net_units"])
    ranked = products.product_performance(august.orders, august.items, august.products, AUGUST)
    lines = ranked.agg(F.sum("net_sales_pence"), F.sum("net_units")).first()
    assert tuple(lines) == (whole["net_sales_pence"], whole["net_units"])


def test_gross_minus_discount_is_net_everywhere(august):
    for view in (ops.overview(august.orders, AUGUST), ops.revenue_series(august.orders, AUGUST)):
        assert view.filter(
            F.col("gross_sales_pence") - F.col("discounts_pence") != F.col("net_sales_pence")
        ).isEmpty()


def test_days_without_trade_are_zero_rows(august):
    series = ops.revenue_series(august.orders, AUGUST)
    got = rows(series, "period_start", "net_sales_pence")
    assert len(got) == 31 and got[0] == (date(2026, 8, 1), 730)
    assert got[1] == (date(2026, 8, 2), 0) and got[30] == (date(2026, 8, 31), 365)


def test_first_week_may_start_before_the_period(august):
    got = rows(ops.revenue_series(august.orders, AUGUST, "week"), "period_start",
               "payment_order_count")
    assert [d for d, _ in got] == [date(2026, 7, 27), date(2026, 8, 3), date(2026, 8, 10),
                                   date(2026, 8, 17), date(2026, 8, 24), date(2026, 8, 31)]
    assert [n for _, n in got] == [1, 4, 1, 1, 0, 1]


def test_weekdays_and_hours(august):
    days = rows(ops.day_of_week(august.orders, AUGUST), "iso_weekday", "weekday",
                "net_sales_pence", "average_order_value_pence")
    assert len(days) == 7 and days[0] == (1, "Monday", 300 + 765 + 365 + 365, 449)
    assert days[3] == (4, "Thursday", 0, 0)
    grid = ops.peak_hours(august.orders, AUGUST)
    assert grid.count() == 168
    assert rows(ops.busiest_hours(grid, 2), "weekday", "hour", "payment_order_count") == [
        ("Monday", 9, 3), ("Monday", 23, 1)]
    assert tuple(ops.hour_totals(grid).first()) == (3, 6)
    assert ops.hour_matrix(grid).first()["h9"] == 3
    steps = {(r["iso_weekday"], r["hour"]): r["intensity"]
             for r in ops.hour_intensity(grid).collect()}
    assert steps[(1, 9)] == 4 and steps[(1, 23)] == 2 and steps[(2, 3)] == 0


def test_channels_are_ranked_and_never_merged(august):
    mix = ops.channel_mix(august.orders, AUGUST)
    assert rows(mix, "channel", "net_sales_pence") == [
        ("in_store", 1395), ("mixed", 765), ("delivery", 400), ("online", 400),
        ("collection", 365), ("unknown", 0)]
    first = mix.first()
    assert first["share_of_payment_orders_percent"] == 37.5
    assert first["share_of_net_sales_percent"] == 41.95
    assert ops.peak_net_sales(mix).first()[0] == 1395


def test_empty_period(shop):
    shop.order("2026-01-01 10:00")
    quiet = shop.orders
    assert tuple(ops.overview(quiet, AUGUST).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert ops.channel_mix(quiet, AUGUST).isEmpty()
    assert tuple(ops.hour_totals(ops.peak_hours(quiet, AUGUST)).first()) == (0, 0)
    assert ops.hour_intensity(ops.peak_hours(quiet, AUGUST)).filter("intensity <> 0").isEmpty()
    flags = results.undefined_flags(ops.overview(quiet, AUGUST)).first()
    assert tuple(flags) == (False, True)


def test_refund_only_period(shop):
    shop.order("2026-08-05 10:00", net=-500, event="refund", units=-1)
    row = ops.overview(shop.orders, AUGUST).first()
    assert (row["net_sales_pence"], row["average_order_value_pence"]) == (-500, 0)
    mix = ops.channel_mix(shop.orders, AUGUST).first()
    assert mix["share_of_net_sales_percent"] is None
    assert mix["share_of_payment_orders_percent"] is None
    assert ops.peak_net_sales(ops.channel_mix(shop.orders, AUGUST)).first()[0] == 0


@pytest.mark.parametrize("then, now, status, percent", [
    (1000, 1500, "comparable", 50.0), (1000, 0, "comparable", -100.0),
    (0, 700, "new_in_period", None), (0, 0, "not_comparable", None),
    (-100, 700, "not_comparable", None)])
def test_comparison_with_the_previous_period(shop, then, now, status, percent):
    window = period(date(2026, 8, 15), date(2026, 8, 31))
    shop.order("2026-08-14 23:30", net=then, event="refund" if then < 0 else "payment")
    shop.order("2026-07-29 00:00", net=0)
    shop.order("2026-07-28 23:59", net=99999)
    shop.order("2026-08-15 00:00", net=now)
    row = ops.overview(shop.orders, window, compare=True).first()
    assert (row["previous_net_sales_pence"], row["net_sales_pence"]) == (then, now)
    assert (row["comparison_status"], row["net_sales_percent_change"]) == (status, percent)


def test_clock_changes(shop):
    # 01:30 happens twice on 25 October: both orders share one local hour.
    shop.order("2026-10-25 01:30", fold=0)
    shop.order("2026-10-25 01:30", fold=1)
    shop.order("2026-03-29 00:30")
    shop.order("2026-03-29 23:30")
    october = period(date(2026, 10, 25), date(2026, 10, 25))
    assert rows(ops.busiest_hours(ops.peak_hours(shop.orders, october)), "hour",
                "payment_order_count") == [(1, 2)]
    march = period(date(2026, 3, 29), date(2026, 3, 29))
    assert rows(ops.revenue_series(shop.orders, march), "payment_order_count") == [(2,)]
    spring = ops.observed_range(shop.orders, "Europe/London").first()
    assert tuple(spring) == (date(2026, 3, 29), date(2026, 10, 25))


def test_limited_results_say_what_they_leave_out(august):
    mix = ops.channel_mix(august.orders, AUGUST)
    top = results.limited(mix, 2)
    assert top.rows.count() == 2
    assert tuple(top.counts.first()) == (2, 6, 2, True)
    assert tuple(results.limited(mix, None).counts.first()) == (6, 6, None, False)


def test_window_predicate_reaches_the_scan(spark, august, tmp_path):
    august.orders.write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = ops.overview(stored, AUGUST)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(occurred_at" in plan and "LessThan(occurred_at" in plan
    assert "channel" not in plan.split("ReadSchema")[1]


def test_month_partitions_serve_periods_of_another_zone(spark):
    """Half past midnight in London on the first is still the month before in New York."""
    from datetime import datetime, timezone



    orders_ = spark.createDataFrame(
        [(1, datetime(2026, 2, 1, 0, 30, tzinfo=timezone.utc), "payment", 1, 500, 500, 0, "2026-02")],
        "order_id long, occurred_at timestamp, event_type string, item_count long,"
        " net_amount long, gross_amount long, discount_amount long, local_month string")
    items = spark.createDataFrame(
        [(1, 7, 1, 500, 0, "2026-02")], "order_id long, product_id long, quantity long,"
        " line_total long, discount_amount long, local_month string")
    january = period(date(2026, 1, 1), date(2026, 1, 31), "America/New_York")
    assert ops.overview(orders_, january).first()["net_sales_pence"] == 500
    assert products.lines_in_period(orders_, items, january).count() == 1
