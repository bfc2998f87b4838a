"""Cell parsing: money, quantities, clocks, channels, kinds and categories."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import clock, labels, money, text


def apply(spark, rows, schema, expression):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["out"] for r in frame.select("i", expression.alias("out")).orderBy("i").collect()]


MONEY = {
    "£17.20": 1720, "-£0.33": -33, "£-0.33": -33, "£1,234.56": 123456, "17.20": 1720,
    "": 0, "   ": 0, "£0": 0, " £3.65 ": 365, "-£-5": 500, "£1,234,567.80": 123456780,
    "£12.3": 1230, "£1.500": 150, "£90071992547409.93": 9007199254740993,
    "£1.005": None, "£0.0000000000001": None, "abc": None, "£1,23.00": None, "£": None,
    "£1.2.3": None, "12,34": None,
}


def test_money(spark):
    got = apply(spark, [(k,) for k in MONEY], "t string", money.money_to_pence(F.col("t")))
    assert dict(zip(MONEY, got)) == MONEY


def test_money_reads_its_cell_a_few_times():
    # Steps that each repeat the ones before took most of an import's time.
    assert str(money.clean_pence(F.col("cell_text"))).count("cell_text") < 15


def test_stripping_by_a_set_only_where_an_end_is_not_visible(spark):
    cells = {"": "", " ": "", "a": "a", " a b ": "a b", "\u2003£5\t": "£5", "\u2003 a": "a",
             "é": "é", " é\xa0": "é", "\x01a": "\x01a", "a\n": "a", "~": "~", "!": "!",
             "£": "£", "5£": "5£", "a\u3000 ": "a"}
    expression = text.stripped(F.col("t"))
    assert "CASE WHEN" in str(expression)
    got = apply(spark, [(k,) for k in cells], "t string", expression)
    assert dict(zip(cells, got)) == cells


def test_missing_money_is_zero(spark):
    assert apply(spark, [(None,)], "t string", money.money_to_pence(F.col("t"))) == [0]


QUANTITY = {"1.0": 1, "-1.0": -1, "3": 3, " 2.00 ": 2, "0": 0, "1e2": 100,
            "": None, "1.5": None, "1.00000000000001": None, "two": None, "1,0": None}


def test_quantity(spark):
    got = apply(spark, [(k,) for k in QUANTITY], "t string", money.whole_quantity(F.col("t")))
    assert dict(zip(QUANTITY, got)) == QUANTITY


def test_unit_price_is_half_up_and_positive(spark):
    rows = [(1000, 3), (-1000, -3), (5, 2), (-365, 1), (7, 0)]
    got = apply(spark, rows, "t bigint, q bigint", money.unit_price(F.col("t"), F.col("q")))
    assert got == [333, 333, 3, 365, None]


def test_means_round_half_away_from_zero(spark):
    rows = [(5, 2), (-5, 2), (7, 3), (10, 0), (0, 4)]
    got = apply(spark, rows, "t bigint, n bigint", money.mean_pence(F.col("t"), F.col("n")))
    assert got == [3, -3, 2, 0, 0]
    rows = [(5, 2), (-5, 2), (10, 0), (10, -1)]
    got = apply(spark, rows, "t bigint, n bigint", money.selling_price(F.col("t"), F.col("n")))
    assert got == [3, -3, None, None]


def _clock(spark, rows):
    wall = clock.wall_time(F.col("d"), F.col("t"))
    zone = clock.zone_of(F.col("z"))
    instant = clock.first_instant(wall, zone)
    both = F.struct(
        instant.alias("utc"), clock.in_clock_gap(wall, instant, zone).alias("gap"),
        clock.occurs_twice(wall, instant, zone).alias("twice"))
    return apply(spark, rows, "d string, t string, z string", both)


def test_wall_time_to_instant(spark):
    got = _clock(spark, [
        ("2026-08-15", "12:30:00", "London"), ("2026-01-15", "12:30", "Europe/London"),
        ("2026-08-15", "", " London "), ("2026-10-25", "01:30:00", "London"),
        ("2026-10-25", "00:30:00", "London"), ("2026-10-25", "02:30:00", "London"),
        ("2026-03-29", "01:30:00", "London"),
    ])
    utc = [r["utc"] for r in got]
    assert utc[:5] == [datetime(2026, 8, 15, 11, 30), datetime(2026, 1, 15, 12, 30),
                       datetime(2026, 8, 14, 23, 0), datetime(2026, 10, 25, 0, 30),
                       datetime(2026, 10, 24, 23, 30)]
    assert [r["twice"] for r in got] == [False, False, False, True, False, False, False]
    assert [r["gap"] for r in got] == [False] * 6 + [True]


def test_unreadable_clock_cells(spark):
    rows = [("", "12:00", "London"), ("15/08/2026", "12:00", "London"),
            ("2026-02-30", "12:00", "London"), ("2026-08-15", "25:00", "London"),
            ("2026-08-15", "noon", "London"), ("2026-08-15", "12:00", "Paris")]
    assert [r["utc"] for r in _clock(spark, rows)] == [None] * 6


CHANNELS = [
    ("Register", "Eat in", "in_store"), ("Register", "Takeaway", "in_store"),
    ("Point of Sale", "Eat In, Takeaway", "mixed"), ("Register", "Takeaway, Eat in", "mixed"),
    ("Register", "Pick Up", "collection"), ("Register", "Eat In, Pick Up", "mixed"),
    ("Register", "Pick Up, Takeaway", "mixed"), ("Register", "eat in, Eat In,", "in_store"),
    ("Uber Eats", "", "delivery"), ("just eat", "Eat in", "delivery"),
    (" Deliveroo ", "", "delivery"), ("Deliveroo Pickup", "", "collection"),
    ("Uber Eats Pickup", "", "collection"), ("Square Online", "", "online"),
    ("Square Online", "Pick up", "collection"), ("Square Online", "Drone", "online"),
    ("Register", "", None), ("Register", "Drone", None), ("Kiosk", "Eat in", None),
    (None, None, None),
]


def test_channel(spark):
    rows = [(s, d) for s, d, _ in CHANNELS]
    got = apply(spark, rows, "s string, d string", labels.channel_of(F.col("s"), F.col("d")))
    assert got == [c for *_, c in CHANNELS]


def test_kind_category_event(spark):
    names = [("Custom Amount",), (" custom amount ",), ("£20 Gift Voucher",), ("gift card",),
             ("Custom Amount Cake",), ("Latte",)]
    assert apply(spark, names, "n string", labels.kind_of(F.col("n"))) == [
        "custom_amount", "custom_amount", "gift_voucher", "gift_voucher", "menu_item",
        "menu_item"]
    raw = [("None",), ("",), (None,), ("Uncategorised",), ("UNCATEGORIZED",), (" Coffee ",)]
    assert apply(spark, raw, "c string", labels.category_of(F.col("c"))) == [
        None, None, None, None, None, "Coffee"]
    events = [("Payment",), (" REFUND ",), ("Void",), (None,)]
    assert apply(spark, events, "e string", labels.event_of(F.col("e"))) == [
        "payment", "refund", None, None]


def test_text_helpers(spark):
    raw = [("  Caffe \t Latte  ",), (None,)]
    assert apply(spark, raw, "v string", text.catalogue_key(F.col("v"))) == ["caffe latte", ""]
    pairs = [("Latte", "Large"), ("Latte", "")]
    label = text.product_label(F.col("n"), F.col("v"))
    assert apply(spark, pairs, "n string, v string", label) == ["Latte · Large", "Latte"]


@pytest.mark.parametrize("start, end, hours", [
    ("2026-10-01", "2026-10-31", 31 * 24 + 1), ("2026-03-01", "2026-03-31", 31 * 24 - 1),
    ("2026-08-01", "2026-08-01", 24)])
def test_periods_follow_the_local_clock(start, end, hours):
    made = clock.period(datetime.fromisoformat(start).date(), datetime.fromisoformat(end).date())
    assert (made.end_utc - made.start_utc).total_seconds() == hours * 3600


def test_period_bounds():
    day = datetime(2026, 1, 1).date
    first = day()
    with pytest.raises(clock.InvalidPeriod):
        clock.period(first, datetime(2025, 12, 31).date())
    with pytest.raises(clock.InvalidPeriod):
        clock.period(first, datetime(2027, 1, 2).date())
    assert clock.period(first, datetime(2027, 1, 1).date()).days == 366
    before = clock.period(datetime(2026, 8, 15).date(), datetime(2026, 8, 31).date()).previous()
    assert (before.start.isoformat(), before.end.isoformat()) == ("2026-07-29", "2026-08-14")
