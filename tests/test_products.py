"""Product ranking, movement, trends, evidence and the catalogue."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.clock import period
from tallyhouse.operators import baskets, catalogue, menu, results
from tallyhouse.operators import products as ops
from tests.test_orders import AUGUST, rows


def tables(shop):
    return shop.orders, shop.items, shop.products


def test_ranking_measures_and_shares(shop):
    latte, large, cake = (shop.product("Latte"), shop.product("Latte", "Large"),
                          shop.product("Cake", ""))
    voucher = shop.product("Gift Voucher", "", "gift_voucher")
    shop.order("2026-08-03 09:00", lines=[(latte, 2, 700), (latte, 1, 350, 50)])
    shop.order("2026-08-04 09:00", lines=[(large, 1, 450), (voucher, 1, 5000)])
    shop.order("2026-08-05 09:00", lines=[(cake, 1, 400)])
    shop.order("2026-08-06 09:00", lines=[(cake, -1, -400)], event="refund")
    got = {(r["product_name"], r["product_variation"]): r
           for r in ops.product_performance(*tables(shop), AUGUST).collect()}
    assert ("Gift Voucher", "") not in got
    first = got[("Latte", "Regular")]
    assert (first["gross_sales_pence"], first["discounts_pence"], first["net_sales_pence"],
            first["net_units"], first["payment_order_count"]) == (1050, 50, 1000, 3, 1)
    assert first["average_selling_price_pence"] == 333
    assert first["share_of_net_sales_percent"] == 68.97
    assert first["share_of_units_percent"] == 75.0
    # Sales and refunds cancel: no units, so no price.
    assert got[("Cake", "")]["average_selling_price_pence"] is None
    assert got[("Cake", "")]["payment_order_count"] == 1

    top = ops.product_performance(*tables(shop), AUGUST, limit=1).first()
    assert top["share_of_net_sales_percent"] == 68.97
    every = ops.product_performance(*tables(shop), AUGUST, kinds=("menu_item", "gift_voucher"))
    assert every.first()["product_name"] == "Gift Voucher"
    totals = ops.performance_totals(*tables(shop), AUGUST).first()
    assert tuple(totals) == (1450, 4)
    assert tuple(results.undefined_flags(every).first()) == (True, False)


def test_ties_are_broken_by_name_then_variation(shop):
    for name, variation in [("B", ""), ("A", "2"), ("A", "1")]:
        shop.order("2026-08-03 09:00", lines=[(shop.product(name, variation), 1, 100)])
    for sort in ops.SORTS:
        ranked = ops.product_performance(*tables(shop), AUGUST, sort=sort)
        assert rows(ranked, "product_name", "product_variation") == [
            ("A", "1"), ("A", "2"), ("B", "")]
    with pytest.raises(ValueError):
        ops.product_performance(*tables(shop), AUGUST, sort="margin")


def test_movers(shop):
    window = period(date(2026, 8, 15), date(2026, 8, 31))
    up, gone, new, odd = (shop.product(n) for n in ("Up", "Gone", "New", "Odd"))
    shop.order("2026-08-01 10:00", lines=[(up, 1, 100), (gone, 2, 500)])
    shop.order("2026-08-02 10:00", lines=[(odd, -1, -50)], event="refund")
    shop.order("2026-08-20 10:00", lines=[(up, 3, 300), (new, 1, 250), (odd, 1, 60)])
    shop.order("2026-07-01 10:00", lines=[(up, 100, 10000)])
    moved = ops.product_movers(*tables(shop), window)
    assert rows(moved, "product_name", "net_sales_change_pence", "net_sales_percent_change",
                "net_units_change", "movement_status") == [
        ("Gone", -500, -100.0, -2, "comparable"), ("New", 250, None, 1, "new_in_period"),
        ("Up", 200, 200.0, 2, "comparable"), ("Odd", 110, None, 2, "not_comparable")]
    assert ops.product_movers(*tables(shop), window, limit=1).count() == 1


def test_trend(shop):
    latte, cake = shop.product("Latte"), shop.product("Cake")
    shop.order("2026-08-01 00:10", lines=[(latte, 1, 365), (cake, 1, 400)])
    shop.order("2026-08-01 12:00", lines=[(latte, 2, 730, 30)])
    shop.order("2026-08-02 12:00", lines=[(latte, -1, -365)], event="refund")
    trend = ops.product_trend(*tables(shop), AUGUST, latte)
    got = rows(trend, "period_start", "net_sales_pence", "net_units", "payment_order_count")
    assert len(got) == 31
    assert got[:3] == [(date(2026, 8, 1), 1065, 3, 2), (date(2026, 8, 2), -365, -1, 0),
                       (date(2026, 8, 3), 0, 0, 0)]
    totals = ops.trend_totals(trend).first()
    assert (totals["net_sales_pence"], totals["average_selling_price_pence"]) == (700, 350)
    assert ops.product_trend(*tables(shop), AUGUST, 999) is None
    assert ops.find_product(shop.products, cake).first()["name"] == "Cake"

    each = ops.product_trends(shop.orders, shop.items, AUGUST, "day")
    one = each.filter(F.col("product_id") == latte).drop("product_id")
    assert each.count() == 62
    assert sorted(one.select(*trend.columns).collect()) == sorted(trend.collect())


def test_trend_scales_with_months_of_stored_lines(shop):
    latte = shop.product("Latte")
    shop.order("2026-08-01 00:10", lines=[(latte, 1, 365)])
    shop.order("2026-06-01 00:10", lines=[(latte, 1, 365)])
    items = shop.items.withColumn(
        "local_month", F.when(F.col("order_id") == 1, "2026-08").otherwise("2026-06"))
    lines = ops.lines_in_period(shop.orders, items, AUGUST)
    assert lines.count() == 1


# --- evidence ---------------------------------------------------------------------------


@pytest.fixture
def evidence(shop):
    a, b, rare, alone = (shop.product(n) for n in ("Alpha", "Beta", "Rare", "Alone"))
    for n in range(6):
        shop.order(f"2026-08-2{n} 10:00", lines=[(a, 1, 100), (b, 1, 50)])
    for n in range(6):
        shop.order(f"2026-08-2{n} 11:00", lines=[(b, 1, 50)])
    for n in range(2):
        shop.order(f"2026-08-2{n} 12:00", lines=[(a, 1, 100, 10), (rare, 1, 900)])
    shop.order("2026-08-20 13:00", lines=[(alone, 1, 0)])
    shop.order("2026-08-01 13:00", lines=[(alone, 1, 40), (a, 2, 200)])
    shop.order("2026-08-02 13:00", lines=[(shop.product("Past"), 1, 40)])
    return shop


WINDOW = period(date(2026, 8, 15), date(2026, 8, 31))


def test_menu_evidence(evidence):
    got = menu.menu_evidence(*tables(evidence), WINDOW, min_pair_orders=2)
    by_name = {r["product_name"]: r for r in got.collect()}
    assert [r["product_name"] for r in got.collect()] == ["Rare", "Alpha", "Beta", "Alone"]
    a = by_name["Alpha"]
    assert (a["net_sales_pence"], a["previous_net_sales_pence"], a["net_sales_change_pence"],
            a["net_sales_percent_change"], a["revenue_direction"]) == (
        780, 200, 580, 290.0, "increasing")
    assert a["discount_rate_percent"] == 2.5
    assert a["share_of_menu_net_sales_percent"] == 24.5283
    # Lift prefers the rare exclusive partner to the frequent one.
    assert (a["attachment_product_name"], a["attachment_pair_orders"]) == ("Rare", 2)
    assert (a["attachment_rate_percent"], a["attachment_lift"]) == (25.0, 1.875)
    totals = menu.evidence_totals(*tables(evidence), WINDOW).first()
    assert tuple(totals) == (3180, 23, 15)
    alone = by_name["Alone"]
    assert alone["attachment_product_id"] is None and alone["discount_rate_percent"] is None
    assert (alone["movement_status"], alone["net_sales_percent_change"]) == (
        "comparable", -100.0)


def test_attachment_needs_the_minimum(evidence):
    got = menu.menu_evidence(*tables(evidence), WINDOW, min_pair_orders=5)
    partners = dict(rows(got, "product_name", "attachment_product_name"))
    assert partners == {"Alpha": "Beta", "Beta": "Alpha", "Rare": None, "Alone": None}


def test_evidence_sorting_filters_and_leaders(evidence):
    got = menu.menu_evidence(*tables(evidence), WINDOW, min_pair_orders=2)
    for direction in ("asc", "desc"):
        names = rows(menu.sort_evidence(got, "discount_rate", direction), "product_name")
        assert names[-1] == ("Alone",)
    assert rows(menu.sort_evidence(got, "product"), "product_name")[0] == ("Alone",)
    assert menu.sort_evidence(got, "movement").first()["product_name"] == "Rare"
    for column in menu.COLUMNS:
        assert menu.sort_evidence(got, column).count() == 4
    with pytest.raises(ValueError):
        menu.sort_evidence(got, "margin")
    assert rows(results.search_products(got, "  REGULAR "), "product_name") != []
    assert rows(results.search_products(got, "ph"), "product_name") == [("Alpha",)]
    assert results.search_products(got, "").count() == 4
    assert results.without_zero_revenue(got).count() == 3
    led = menu.leading_products(got).first()
    assert (led["variation_count"], led["sales_product_name"], led["units_product_name"]) == (
        4, "Rare", "Beta")


def test_evidence_reads_lines_twice_whatever_the_catalogue(evidence):
    got = menu.menu_evidence(*tables(evidence), WINDOW)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_trends_shuffle_no_empty_periods(shop):
    tea, milk = shop.product("Tea"), shop.product("Milk")
    shop.order("2026-08-05 12:00", lines=[(tea, 1, 300)])
    shop.order("2026-08-05 12:00", event="refund", lines=[(tea, -1, -100)])
    shop.order("2026-08-31 12:00", lines=[(milk, 2, 500), (tea, 1, 300)])
    found = ops.product_trends(shop.orders, shop.items, AUGUST, "day")
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["product_id"], r["period_start"].day): r["net_sales_pence"]
           for r in found.collect()}
    assert found.count() == len(got) == 62
    assert {k: v for k, v in got.items() if v} == {(1, 5): 200, (1, 31): 300, (2, 31): 500}


# --- catalogue ----------------------------------------------------------------------------


def test_resolving_names(spark, shop):
    shop.product("Caffe Latte", "Regular"), shop.product("Caffe Latte", "Large")
    shop.product("Coffee Bean", "")
    asked = spark.createDataFrame(
        [(1, "  caffe   LATTE ", "large"), (2, "Caffe Latte", None), (3, "coffee beans", None),
         (4, "Coffee Bean", None), (5, "  ", None), (6, "Coffee Bean", ""), (7, None, None),
         (8, "Caffe Latte", "Huge")],
        "request_id int, name string, variation string")
    got = {r["request_id"]: r for r in catalogue.resolve_products(asked, shop.products).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        1: "resolved", 2: "ambiguous", 3: "not_found", 4: "resolved", 5: "not_found",
        6: "resolved", 7: "not_found", 8: "not_found"}
    assert got[1]["product_id"] == 2
    assert [c["variation"] for c in got[2]["candidates"]] == ["Large", "Regular"]
    assert rows(catalogue.catalogue(shop.products, 2), "variation") == [("Large",), ("Regular",)]
    assert catalogue.catalogue_size(shop.products).first()[0] == 3


def test_candidates_are_cut_only_on_demand(spark, shop):
    for n in range(40):
        shop.product("Tea", f"{n:02d}")
    asked = spark.createDataFrame([(1, "tea", None)], "request_id int, name string,"
                                                      " variation string")
    for limit, listed in ((None, 40), (25, 25)):
        row = catalogue.resolve_products(asked, shop.products, limit).first()
        assert row["matches"] == 40
        assert [c["variation"] for c in row["candidates"]] == [f"{n:02d}" for n in range(listed)]


def test_candidates_of_one_name_are_joined_in_several_tasks(spark, shop, monkeypatch):
    monkeypatch.setattr(catalogue, "BLOCK", 4, raising=False)
    for n in range(40):
        shop.product("Tea", f"{n:02d}")
    asked = spark.createDataFrame(
        [(1, "tea", None), (2, "TEA ", None), (2, "TEA ", None), (3, "tea", "07"),
         (4, "coffee", None), (None, "tea", "09")],
        "request_id int, name string, variation string")
    got = catalogue.candidate_rows(asked, shop.products).withColumn(
        "task", F.spark_partition_id()).collect()
    assert sorted((r["request_id"] or 0, r["product_id"]) for r in got) == sorted(
        [(i, n) for i in (1, 2, 2) for n in range(1, 41)] + [(3, 8), (0, 10)])
    assert len({r["task"] for r in got if r["request_id"] == 1}) > 1


def test_requests_of_one_name_are_joined_in_several_tasks(spark, shop, monkeypatch):
    monkeypatch.setattr(catalogue, "PART", 10, raising=False)
    for n in range(3):
        shop.product("Tea", f"{n}")
    asked = spark.createDataFrame(
        [*((n, "tea", None) for n in range(100)), (5, "tea", None), (None, "tea", None),
         (100, "tea", "1"), (101, "milk", None)],
        "request_id int, name string, variation string")
    # A variation that is the same constant in every row deals them no other way.
    for requests in (asked, asked.withColumn("variation", F.lit(None).cast("string"))):
        got = catalogue.candidate_rows(requests, shop.products).withColumn(
            "task", F.spark_partition_id()).collect()
        whole = 1 if requests is asked else 3
        assert sorted((-1 if r["request_id"] is None else r["request_id"], r["product_id"])
                      for r in got if r["request_id"] != 100) == sorted(
            (i, n) for i in (*range(100), 5, -1) for n in (1, 2, 3))
        assert sum(r["request_id"] == 100 for r in got) == whole
        assert len({r["task"] for r in got if r["request_id"] != 100}) > 1


def test_answers_are_written_once_for_equal_requests(spark, shop):
    for n in range(5):
        shop.product("Tea", f"{n}")
    asked = spark.createDataFrame(
        [(1, "tea", None), (2, " TEA", None), (None, "tea", None), (3, "tea", "3"),
         (4, "milk", None)], "request_id int, name string, variation string")

    def ids(found):
        return F.array_join(F.transform(found, lambda c: c["product_id"].cast("string")), ",")

    got = catalogue.resolve_products(asked, shop.products, listed=ids)
    assert {(r["request_id"], r["status"], r["product_id"], r["candidates"])
            for r in got.collect()} == {
        *((i, "ambiguous", None, "1,2,3,4,5") for i in (1, 2, None)),
        (3, "resolved", 4, None), (4, "not_found", None, None)}


def test_lists_are_written_once_for_equal_requests(spark, tmp_path):
    named = F.concat(F.lit("tea "), F.pmod("id", F.lit(60)).cast("string")).alias("name")
    products = spark.range(240_000).select(
        (F.col("id") + 10_000_000).alias("product_id"), named, F.lit("").alias("variation"),
        F.lit("menu_item").alias("kind"))
    asked = spark.range(1500).select(
        F.col("id").alias("request_id"), named, F.lit(None).cast("string").alias("variation"))

    def ids(found):
        return F.array_join(F.transform(found, lambda c: c["product_id"].cast("string")), ",")

    target = tmp_path / "resolved"
    catalogue.resolve_products(asked, products, listed=ids).write.parquet(str(target))
    got = spark.read.parquet(str(target))
    text = F.length("candidates")
    assert tuple(got.agg(F.count("*"), F.sum("matches"), F.sum(text)).first()) == (
        1500, 1500 * 4000, 1500 * (4000 * 9 - 1))
    assert got.select("candidates").distinct().count() == 60
    # 54 MB of text, of which 2 MB differ.
    assert sum(f.stat().st_size for f in target.glob("*.parquet")) < 5_000_000


def test_requests_of_one_name_are_answered_in_several_tasks(spark, shop, monkeypatch):
    monkeypatch.setattr(catalogue, "WRITTEN", 500, raising=False)
    for n in range(5):
        shop.product("Tea", f"{n}")
    asked = spark.createDataFrame(
        [*((n, "tea", None) for n in range(200)), (7, "tea", None), (None, "tea", None),
         (None, "milk", None), (None, None, None), (201, "TEA", "3")],
        "request_id int, name string, variation string")
    got = catalogue.resolve_products(asked, shop.products, max_candidates=2).withColumn(
        "task", F.spark_partition_id()).collect()
    listed = sorted(r["request_id"] if r["request_id"] is not None else -1 for r in got
                    if r["candidates"] and len(r["candidates"]) == 2 and r["matches"] == 5)
    assert listed == sorted([*range(200), 7, -1])
    assert len(got) == 205
    assert {(r["request_id"], r["status"], r["product_id"], r["matches"]) for r in got
            if r["candidates"] is None} == {
        (None, "not_found", None, 0), (201, "resolved", 4, 1)}
    assert len({r["task"] for r in got if r["candidates"]}) > 1


# --- baskets --------------------------------------------------------------------------------


@pytest.fixture
def four_baskets(shop):
    a, b, c = (shop.product(n) for n in "ABC")
    for other in (b, b, c):
        shop.order("2026-08-03 10:00", lines=[(a, 1, 100), (other, 1, 100), (a, 2, 200)])
    shop.order("2026-08-03 10:00", lines=[(b, 1, 100), (c, 1, 100)])
    # None of these is a basket of the period's menu.
    shop.order("2026-08-04 10:00", lines=[(a, -1, -100), (b, -1, -100)], event="refund")
    shop.order("2026-08-04 10:00", lines=[(shop.product("V", "", "gift_voucher"), 1, 100)])
    shop.order("2026-09-04 10:00", lines=[(a, 1, 100), (b, 1, 100)])
    shop.order("2026-08-05 10:00", net=100)
    return shop


@pytest.mark.parametrize("width", [200, 1])
def test_pair_measures(four_baskets, width):
    lines = baskets.basket_lines(*tables(four_baskets), AUGUST)
    merged = baskets.baskets_of(lines, width)
    assert merged.eligible_orders().first()[0] == 4
    got = {(r["product_a_name"], r["product_b_name"]): r
           for r in baskets.basket_pairs(merged, four_baskets.products).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "C")}
    ab = got[("A", "B")]
    assert (ab["pair_orders"], ab["product_a_orders"], ab["product_b_orders"]) == (2, 3, 3)
    assert (ab["support_percent"], ab["confidence_a_to_b_percent"],
            ab["confidence_b_to_a_percent"], ab["lift"]) == (50.0, 66.6667, 66.6667, 0.8889)
    assert tuple(baskets.pair_totals(merged, 2).first()) == (4, 3, 1)
    frequent = baskets.basket_pairs(merged, four_baskets.products, min_pair_orders=2)
    assert rows(frequent, "product_a_name", "product_b_name") == [("A", "B")]
    assert baskets.basket_pairs(merged, four_baskets.products, limit=1).count() == 1


def test_pair_order_is_total(four_baskets):
    merged = baskets.baskets_of(baskets.basket_lines(*tables(four_baskets), AUGUST))
    expected = {"pair_orders": ["AB", "AC", "BC"], "lift": ["AB", "AC", "BC"],
                "support": ["AB", "AC", "BC"]}
    for sort, names in expected.items():
        got = rows(baskets.basket_pairs(merged, four_baskets.products, sort=sort),
                   "product_a_name", "product_b_name")
        assert ["".join(n) for n in got] == names
    with pytest.raises(ValueError):
        baskets.basket_pairs(merged, four_baskets.products, sort="profit")


def test_attachments(four_baskets):
    lines = baskets.basket_lines(*tables(four_baskets), AUGUST)
    got = baskets.product_attachments(lines, four_baskets.products, 1)
    assert rows(got, "product_name", "pair_orders", "product_orders", "attachment_rate_percent",
                "reverse_attachment_rate_percent", "support_percent", "lift") == [
        ("B", 2, 3, 66.6667, 66.6667, 50.0, 0.8889), ("C", 1, 2, 33.3333, 50.0, 25.0, 0.6667)]
    assert baskets.product_attachments(lines, four_baskets.products, 99) is None
    assert tuple(baskets.attachment_totals(lines, 1).first()) == (3, 4)
    few = baskets.product_attachments(lines, four_baskets.products, 1, min_pair_orders=2)
    assert few.count() == 1


def test_equal_partners_go_to_the_later_name(shop):
    a = shop.product("A")
    for name in ("B", "C"):
        shop.order("2026-08-03 10:00", lines=[(a, 1, 1), (shop.product(name), 1, 1)])
    merged = baskets.baskets_of(baskets.basket_lines(*tables(shop), AUGUST))
    best = baskets.strongest_attachments(merged, shop.products, 1)
    assert dict(rows(best, "product_id", "attachment_product_name"))[a] == "C"


def test_pair_points_and_search(four_baskets):
    merged = baskets.baskets_of(baskets.basket_lines(*tables(four_baskets), AUGUST))
    pairs = baskets.basket_pairs(merged, four_baskets.products)
    assert results.search_pairs(pairs, "c · reg").count() == 2
    assert results.search_pairs(pairs, " ").count() == 3
    undefined = pairs.withColumn("lift", F.when(F.col("pair_orders") > 1, F.col("lift")))
    assert rows(results.pair_points(undefined), "label_a", "label_b") == [
        ("A · Regular", "B · Regular")]


def test_basket_lines_are_distinct_along_one_sort(four_baskets, capsys):
    orders, items, products = tables(four_baskets)
    lines = baskets.basket_lines(orders.union(orders), items.union(items), products, AUGUST)
    got = [tuple(r) for r in lines.collect()]
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3), (4, 2), (4, 3)]
    # A task holds the lines in sorts only, and widths are read along the order of the repeats.
    capsys.readouterr()
    lines.explain()
    repeats = capsys.readouterr().out
    baskets.baskets_of(lines).wide.explain()
    widths = capsys.readouterr().out
    assert "HashAggregate" not in repeats + widths
    assert widths.count("+- Sort") == repeats.count("+- Sort") > 0


def test_shuffled_rows_are_read_in_small_parts(spark):
    """Two million short rows, about 20 MB, which the usual 64 MB would leave in one task."""
    changed = {"spark.sql.shuffle.partitions": "40",
               "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    usual = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        ids = spark.range(2_000_000).groupBy(F.xxhash64("id").alias("key")).count()
        tasks = ids.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
    assert 1 < tasks < 40


def test_wide_and_hot_baskets_match_brute_force(spark):
    """One order with every product, one set shared by a third of the orders, and the rest."""
    wide = [(0, p) for p in range(60)]
    copies = [(o, p) for o in range(1, 40) for p in (3, 5, 7)]
    mixed = [(o, (o * k) % 61) for o in range(40, 120) for k in (1, 2, 3, 5)]
    lines = spark.createDataFrame(wide + copies + mixed, "order_id long, product_id long"
                                  ).distinct()
    by_order = {}
    for o, p in wide + copies + mixed:
        by_order.setdefault(o, set()).add(p)
    expected = {}
    for held in by_order.values():
        for a in held:
            for b in held:
                if a < b:
                    expected[(a, b)] = expected.get((a, b), 0) + 1
    for width in (200, 10, 2):
        merged = baskets.baskets_of(lines, width)
        got = {(r["a"], r["b"]): r["pair_orders"] for r in merged.pair_counts().collect()}
        assert got == expected
        assert {(r["a"], r["b"]): r["pair_orders"] for r in merged.pair_counts(4).collect()} == {
            k: n for k, n in expected.items() if n >= 4}
        assert merged.eligible_orders().first()[0] == len(by_order)
    dealt = lines.withColumn("width", F.lit(60)).filter("order_id = 0")
    blocks = baskets._block_pairs(dealt, block=7)
    assert blocks.count() == blocks.distinct().count() == 60 * 59 // 2
