
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyhouse.functions.clock import Period, period  # noqa: E402
from tallyhouse.functions.text import product_label  # noqa: E402
from tallyhouse.operators import (  # noqa: E402
    baskets, catalogue, daily, features, ingest, menu, orders, products, results, scoring, series,
)
from tallyhouse.plans import backtest, boosting, forecast  # noqa: E402
from tallyhouse.plans.evaluations import EvaluationStore  # noqa: E402
from tallyhouse.plans.methods import METHODS  # noqa: E402
from tallyhouse.plans.settle import settled  # noqa: E402
from tallyhouse.session import configure, shared_folder, ship, short_methods  # noqa: E402
from tallyhouse.sources import derived_exports, warehouse_tables  # noqa: E402

# The orders' whole span in London days; its later half, whose previous period is the
# earlier half; the same orders on New York days; the events' month.
ALL = period(date(1995, 1, 1), date(2001, 8, 1), max_days=None)
LATER = period(date(1998, 4, 18), date(2001, 8, 1), max_days=None)
NEW_YORK = period(date(1994, 12, 31), date(2001, 8, 1), "America/New_York", max_days=None)
EVENTS = period(date(2024, 1, 1), date(2024, 1, 31))
KINDS = ("menu_item", "gift_voucher", "custom_amount")
PAIR_MINIMUM = 2
BRAND_MINIMUM = 20


def entry(spark: SparkSession) -> DataFrame:
    """Headline totals of the whole span against the one before, on the smallest folder."""
    return queries()["overview_compared"](spark, "/root/testdata/sf0.001")


# --- inputs -----------------------------------------------------------------------------


def _sales(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tables = warehouse_tables.sales_tables(spark, folder)
    return tables.orders, tables.items, tables.products


def _brand_sales(spark: SparkSession, folder: str):
    """The same lines with the 25 brands as products: few products, dense pairs."""
    o, i, p = _sales(spark, folder)
    number = F.regexp_extract("variation", r"(\d+)$", 1).cast("bigint")
    numbered = p.select(F.col("product_id").alias("part"), number.alias("product_id"))
    lines = i.withColumnRenamed("product_id", "part").join(numbered, "part").drop("part")
    brands = p.select(
        number.alias("product_id"), F.col("variation").alias("name"), F.lit("").alias("variation"),
        F.lit(None).cast("string").alias("category"), F.lit("menu_item").alias("kind"),
    ).distinct()
    return o, lines, brands


def _merged(sales, window: Period) -> tuple[baskets.Baskets, DataFrame]:
    o, i, p = sales
    return baskets.baskets_of(baskets.basket_lines(o, i, p, window)), p


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    return series.daily_series(
        warehouse_tables.nation_orders(spark, folder), series="series_id")


def _leader(spark: SparkSession, folder: str) -> int:
    """Id of the product that leads by net sales."""
    top = products.product_performance(*_sales(spark, folder), ALL, limit=1)
    return top.first()["product_id"]


def _steps(folded: DataFrame) -> DataFrame:
    """One row per forecast day instead of one per fold."""
    both = F.arrays_zip("forecast", "actual")
    return folded.select(
        "series_id", "target", "method", "origin", F.posexplode(both).alias("at", "v")
    ).select("series_id", "target", "method", "origin", (F.col("at") + 1).alias("step"),
             F.round("v.forecast", 4).alias("forecast"), "v.actual")


def _rounded(frame: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; these places do not."""
    places = {"mae": 4, "wape_percent": 6, "absolute_error_total": 2, "absolute_actual_total": 2}
    return frame.select(*[F.round(c, places[c]).alias(c) if c in places else c
                          for c in frame.columns])


def _requests(catalogue_rows: DataFrame) -> DataFrame:
    """A request per catalogue row: shouted, oddly spaced, every second without variation."""
    n = F.col("product_id")
    return catalogue_rows.select(
        n.alias("request_id"),
        F.when(n % 7 == 0, F.concat(F.col("name"), F.lit("s")))
        .otherwise(F.concat(F.lit("  "), F.upper("name"), F.lit(" "))).alias("name"),
        F.when(n % 2 == 0, F.col("variation")).alias("variation"),
    )


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    p = warehouse_tables.product_catalogue(spark, folder)

    def ids(found):
        return F.array_join(F.transform(found, lambda c: c["product_id"].cast("string")), ",")

    found = catalogue.resolve_products(_requests(p), p, listed=ids)
    return found.withColumnRenamed("candidates", "candidate_ids")


def _observed_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days with orders only, so gaps are there to be found."""
    o = warehouse_tables.nation_orders(spark, folder)
    day = F.to_date(F.from_utc_timestamp("occurred_at", ALL.zone)).alias("day")
    return o.groupBy("series_id", day).agg(*orders.measures()).select(
        "series_id", "day", *series.TARGETS)


def _parsed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, stored like an import stages them: several branches read them."""
    tx = ingest.parse_transactions(derived_exports.transaction_rows(spark, folder))
    lines = ingest.parse_items(derived_exports.item_rows(spark, folder))
    with short_methods(spark):
        return settled(tx), settled(lines)


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    built = ingest.build_orders(*_parsed(spark, folder), "till")
    return built.drop("_file", "_split", "_seq", "source").withColumn(
        "occurred_at", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))


def _export_issues(spark: SparkSession, folder: str) -> DataFrame:
    tx, lines = _parsed(spark, folder)
    found = (
        ingest.transaction_issues(tx, lines).select("code", "severity")
        .unionByName(ingest.row_issues(lines).select("code", "severity"))
        .unionByName(ingest.orphan_issues(lines, ingest.build_orders(tx, lines, "till"))
                     .select("code", "severity"))
    )
    return ingest.issue_counts(found)


def _redelivery(spark: SparkSession, folder: str) -> DataFrame:
    """The extraction against a stored version in which every 11th order differs."""
    tx, lines = _parsed(spark, folder)
    new = ingest.build_orders(tx, lines, "till")
    number = F.substring("source_order_id", 4, 20).cast("bigint")
    old = new.withColumn("net_amount", F.col("net_amount")
                         + F.when(number % 11 == 0, F.lit(1)).otherwise(F.lit(0)))
    sound = ingest.sound(lines).withColumn("source", F.lit("till"))
    stored = sound.filter(~((number % 13 == 0) & (F.col("line_total") % 2 == 0)))
    compared = ingest.compare_with_stored(new, sound, old, stored)
    return compared.select(
        "source_order_id", F.size("differences").cast("bigint").alias("differences"))


def _summaries(spark: SparkSession, folder: str) -> DataFrame:
    _, i, p = _sales(spark, folder)
    return ingest.summarise_lines(i.join(p, "product_id"))


def _reconciled(spark: SparkSession, folder: str) -> DataFrame:
    """The derived extraction against a summary written from the stored lines."""
    tx, lines = _parsed(spark, folder)
    totals = _summaries(spark, folder)
    text = derived_exports.money_text
    summary = totals.select(
        text(F.col("net_sales")).alias("Net Sales"),
        text(F.col("product_sales")).alias("Product Sales"),
        text(F.col("refunds")).alias("Refunds"),
        F.col("items_sold").cast("string").alias("Units Sold"),
        F.col("items_refunded").cast("string").alias("Items Refunded"),
    )
    built = ingest.build_orders(tx, lines, "till")
    kept = ingest.sound(lines).join(
        built.select("source_order_id"), "source_order_id", "left_semi")
    return ingest.reconciliation(built, kept, summary)


def _export_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products of the derived lines that a catalogue of the first brand lacks."""
    _, lines = _parsed(spark, folder)
    known = warehouse_tables.product_catalogue(spark, folder).filter("variation = 'Brand#1'")
    return ingest.new_products(ingest.sound(lines), known)


def _import_days(found: DataFrame, *keys: str) -> DataFrame:
    """Day totals as three imports would have kept them, each with its share of the orders."""
    dealt = found.withColumn("import_batch_id", F.pmod("order_id", F.lit(3)))
    return daily.day_totals(dealt, ALL.zone, "import_batch_id", *keys)


def _series_of_days(spark: SparkSession, folder: str) -> DataFrame:
    parts = _import_days(warehouse_tables.nation_orders(spark, folder), "series_id")
    return series.filled_series(
        daily.merged(parts, "series_id", "day").select("series_id", "day", *series.TARGETS))


def _stored_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """The baselines a second time, after the nations up to the letter I got one more day."""
    now = settled(_nations(spark, folder))
    ends = now.groupBy("series_id").agg(F.max("day").alias("last"))
    before = now.join(ends, "series_id").filter(
        (F.col("series_id") >= "J") | (F.col("day") < F.col("last"))).drop("last")
    store = EvaluationStore(spark, f"{shared_folder(spark)}/evaluations-{uuid.uuid4().hex}")
    methods = ("seasonal_naive", "same_weekday_mean_4", "trailing_mean_28")
    backtest.run_backtest(before, methods=methods, evaluations=store)
    return _rounded(backtest.run_backtest(now, methods=methods, evaluations=store).drop("status"))


# --- registry ---------------------------------------------------------------------------


def _registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def so(s, d):
        return warehouse_tables.sales_orders(s, d)

    def grid(s, d):
        return orders.peak_hours(warehouse_tables.event_orders(s, d), EVENTS)

    def pairs(s, d):
        return baskets.basket_pairs(*_merged(_sales(s, d), ALL))

    def brand_pairs(s, d):
        return baskets.basket_pairs(
            *_merged(_brand_sales(s, d), ALL), BRAND_MINIMUM, sort="lift")

    def evidence(s, d, window=ALL):
        return menu.menu_evidence(*_sales(s, d), window, PAIR_MINIMUM)

    def attachments(s, d):
        o, i, p = _sales(s, d)
        return baskets.product_attachments(
            baskets.basket_lines(o, i, p, ALL), p, _leader(s, d))

    def ridge(s, d):
        return _rounded(backtest.evaluate(backtest.ridge_folds(settled(_nations(s, d)))))

    return {
        # order level
        "overview": lambda s, d: orders.overview(so(s, d), ALL),
        "overview_compared": lambda s, d: orders.overview(so(s, d), LATER, compare=True),
        "revenue_by_day": lambda s, d: orders.revenue_series(so(s, d), ALL, "day"),
        "revenue_by_week": lambda s, d: orders.revenue_series(so(s, d), ALL, "week"),
        "revenue_by_day_new_york": lambda s, d: orders.revenue_series(so(s, d), NEW_YORK, "day"),
        "day_of_week": lambda s, d: orders.day_of_week(so(s, d), ALL),
        "peak_hours": grid,
        "busiest_hours": lambda s, d: orders.busiest_hours(grid(s, d), 10),
        "hour_totals": lambda s, d: orders.hour_totals(grid(s, d)),
        "hour_matrix": lambda s, d: orders.hour_matrix(grid(s, d)),
        "hour_intensity": lambda s, d: orders.hour_intensity(grid(s, d)),
        "channel_mix": lambda s, d: orders.channel_mix(so(s, d), ALL),
        "observed_range": lambda s, d: orders.observed_range(so(s, d), ALL.zone),
        "series_totals": lambda s, d: orders.series_totals(
            orders.revenue_series(so(s, d), ALL, "week")),
        "weekday_peak": lambda s, d: orders.peak_net_sales(orders.day_of_week(so(s, d), ALL)),
        "channel_peak": lambda s, d: orders.peak_net_sales(orders.channel_mix(so(s, d), ALL)),
        # products
        "product_performance": lambda s, d: products.product_performance(*_sales(s, d), ALL),
        "product_performance_all_kinds": lambda s, d: products.product_performance(
            *_sales(s, d), ALL, sort="net_units", kinds=KINDS, limit=100),
        "performance_totals": lambda s, d: products.performance_totals(*_sales(s, d), ALL),
        "product_movers": lambda s, d: products.product_movers(*_sales(s, d), LATER),
        "product_trend": lambda s, d: products.product_trend(
            *_sales(s, d), ALL, _leader(s, d), "week"),
        "product_trends": lambda s, d: products.product_trends(*_sales(s, d)[:2], ALL, "week"),
        "trend_totals": lambda s, d: products.trend_totals(
            products.product_trend(*_sales(s, d), ALL, _leader(s, d), "day")),
        # baskets
        "basket_pairs": pairs,
        "brand_pairs": brand_pairs,
        "pair_totals": lambda s, d: baskets.pair_totals(
            _merged(_sales(s, d), ALL)[0], PAIR_MINIMUM),
        "product_attachments": attachments,
        "attachment_totals": lambda s, d: baskets.attachment_totals(
            baskets.basket_lines(*_sales(s, d), ALL), _leader(s, d)),
        "strongest_attachments": lambda s, d: baskets.strongest_attachments(
            *_merged(_sales(s, d), ALL), PAIR_MINIMUM),
        # product evidence and result helpers
        "menu_evidence": lambda s, d: evidence(s, d, LATER),
        "menu_evidence_cheapest": lambda s, d: menu.sort_evidence(
            evidence(s, d), "average_price", "asc"),
        "evidence_totals": lambda s, d: menu.evidence_totals(*_sales(s, d), ALL),
        "leading_products": lambda s, d: menu.leading_products(evidence(s, d)),
        "undefined_flags": lambda s, d: results.undefined_flags(evidence(s, d)),
        "limited_counts": lambda s, d: results.limited(
            products.product_performance(*_sales(s, d), ALL), 10).counts,
        "product_search": lambda s, d: results.without_zero_revenue(results.search_products(
            products.product_performance(*_sales(s, d), ALL), " RING brand#1")),
        "pair_search": lambda s, d: results.search_pairs(brand_pairs(s, d), "brand#7"),
        "pair_points": lambda s, d: results.pair_points(brand_pairs(s, d)),
        "catalogue": lambda s, d: catalogue.catalogue(
            warehouse_tables.product_catalogue(s, d)).select(
                "*", product_label(F.col("name"), F.col("variation")).alias("label")),
        "catalogue_size": lambda s, d: catalogue.catalogue_size(
            warehouse_tables.product_catalogue(s, d)),
        "resolve_products": _resolved,
        # ingestion, over export rows derived from the tables
        "ingested_orders": _ingested,
        "ingest_issues": _export_issues,
        "redelivered_orders": _redelivery,
        "line_summary": _summaries,
        "reconciliation": _reconciled,
        "new_products": _export_products,
        "candidate_rows": lambda s, d: catalogue.candidate_rows(
            _requests(warehouse_tables.product_catalogue(s, d)),
            warehouse_tables.product_catalogue(s, d)).select("request_id", "product_id"),
        # day totals kept by imports
        "revenue_of_days_by_week": lambda s, d: daily.revenue_of_days(
            _import_days(so(s, d), "channel"), ALL, "week"),
        "series_of_days": _series_of_days,
        # forecasting
        "daily_series": lambda s, d: _nations(s, d).withColumn("traded", series.traded()),
        "series_violations": lambda s, d: series.series_violations(_observed_days(s, d)),
        "design_matrix": lambda s, d: features.design_matrix(_nations(s, d), True, True),
        "forecast_days": lambda s, d: series.forecast_days(_nations(s, d), 14),
        "folds": lambda s, d: backtest.folds(_nations(s, d)),
        "short_series": lambda s, d: backtest.short_series(series.daily_series(
            so(s, d), series="customer_id")),
        "series_status": lambda s, d: backtest.series_status(series.daily_series(
            so(s, d), series="customer_id", training_days=None)),
        "baseline_forecasts": lambda s, d: _steps(backtest.baseline_folds(_nations(s, d))),
        "baseline_backtest": lambda s, d: _rounded(
            backtest.evaluate(backtest.baseline_folds(_nations(s, d)))),
        "stored_backtest": _stored_backtest,
        "ridge_backtest": ridge,
        "full_backtest": lambda s, d: scoring.ranked_methods(
            backtest.run_backtest(_nations(s, d), methods=tuple(METHODS))),
        "forecast": lambda s, d: forecast.forecast(_nations(s, d), series.TARGETS),
        "forecast_totals": lambda s, d: scoring.forecast_total(
            forecast.forecast(_nations(s, d), series.TARGETS, with_accuracy=False)),
        "boosted_forecast": lambda s, d: boosting.boosted_forecast(_nations(s, d), series.TARGETS),
    }


def _added():
    """(queries, SQL) of the training-data operators and the pipeline, where they are present."""
    try:
        import corpus_pipeline
        from tallyhouse.llm import queries as llm
    except ImportError:
        return {}, {}
    pipeline_sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**llm.queries(), "pipeline": corpus_pipeline.run}, {**llm.oracle_sql(), **pipeline_sql}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operation; each takes the session and a table folder."""
    def configured(run):
        return lambda spark, folder: run(ship(configure(spark)), folder)

    return {name: configured(run) for name, run in (_registry() | _added()[0]).items()}


def oracle_sql() -> dict[str, str]:
    """Equivalent DuckDB SQL; fitted models have none."""
    from oracles import statements

    return statements() | _added()[1]
