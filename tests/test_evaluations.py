"""Stored backtests: scored once, and again only for what changed."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import backtest, methods
from tallyhouse.plans.evaluations import EvaluationStore, fingerprint
from tallyhouse.plans.forecast import forecast
from tests.test_forecasting import daily, noisy


@pytest.fixture
def store(spark, tmp_path):
    return EvaluationStore(spark, str(tmp_path / "evaluations"))


def counted(monkeypatch, name="ridge_holiday"):
    """The method under its name, noting the series of every call."""
    known, calls = methods.METHODS[name], []

    def paths(histories, horizon):
        calls.append(sorted({r["series_id"] for r in histories.select("series_id").collect()}))
        return known.paths(histories, horizon)

    monkeypatch.setitem(methods.METHODS, name, methods.Method(
        name, known.min_history, paths=paths, version=known.version))
    return calls


def rows(frame):
    return sorted(tuple(r) for r in frame.drop("reused").collect())


def test_second_forecast_fits_no_fold(spark, store, monkeypatch):
    calls = counted(monkeypatch)
    both = daily(spark, noisy(150), name="a").unionByName(daily(spark, noisy(150, 9), name="b"))
    plain = forecast(both)
    first = forecast(both, evaluations=store)
    assert calls == [["a", "b"]]
    assert rows(first) == rows(plain) == rows(forecast(both, evaluations=store))
    assert calls == [["a", "b"]]


def test_only_the_changed_series_is_scored_again(spark, store, monkeypatch):
    calls = counted(monkeypatch)
    names = ("seasonal_naive", "ridge_holiday")
    a, b = daily(spark, noisy(150), name="a"), daily(spark, noisy(150, 9), name="b")
    backtest.run_backtest(a.unionByName(b), targets=("net_units",), methods=names, evaluations=store)
    changed = b.withColumn("net_units", F.col("net_units") + F.when(
        F.col("day") == F.lit(b.agg(F.max("day")).first()[0]), 1).otherwise(0))
    now = a.unionByName(changed)
    found = backtest.run_backtest(now, targets=("net_units",), methods=names, evaluations=store)
    assert calls == [["a", "b"], ["b"]]
    assert {(r["series_id"], r["reused"]) for r in found.collect()} == {("a", True), ("b", False)}
    assert rows(found.select("series_id", "method", "folds", "mae", "wape_percent")) == rows(
        backtest.run_backtest(now, targets=("net_units",), methods=names).select(
            "series_id", "method", "folds", "mae", "wape_percent"))


def test_a_new_version_of_a_method_is_another_result(spark, store):
    series = daily(spark, noisy(140))
    def tried(version, value):
        own = methods.Method("flat", 1, version=version, expression=lambda h, n: F.array_repeat(
            F.lit(float(value)), n))
        return backtest.run_backtest(series, targets=("net_units",), methods=[own],
                                     evaluations=store).first()
    one, two, again = tried(1, 0), tried(2, 100), tried(1, 0)
    assert one["mae"] != two["mae"] and again["mae"] == one["mae"]
    assert [r["reused"] for r in (one, two, again)] == [False, False, True]


def test_results_stored_twice_count_once(spark, store):
    shared = backtest.fold_histories(daily(spark, noisy(140)), targets=("net_units",))
    methods_ = methods.chosen(["seasonal_naive"])
    store.evaluate(shared, methods_, 14)
    store._append(spark.createDataFrame(store.rows().collect(), store.rows().schema))
    assert store.evaluate(shared, methods_, 14).count() == 1


def test_short_series_and_no_series(spark, store):
    short = daily(spark, [1.0] * 20, name="s")
    found = backtest.run_backtest(short, methods=("seasonal_naive",), evaluations=store).collect()
    assert {r["status"] for r in found} == {backtest.SHORT} and len(found) == 3
    assert backtest.run_backtest(short.limit(0), methods=("seasonal_naive",),
                                 evaluations=store).count() == 0


def test_fingerprints_tell_histories_apart(spark):
    def row(values, first="2026-01-05", origins=(2,)):
        return (first, list(origins), values)
    different = [row([1.0, 2.0]), row([12.0]), row([1.0, None]), row([1.0]), row([1.0, 2.0 + 1e-12]),
                 row([1.0, 2.0], first="2026-01-06"), row([1.0, 2.0], origins=(2, 3))]
    frame = spark.createDataFrame(
        different, "first_day string, origins array<int>, values array<double>")
    assert frame.select(fingerprint(14)).distinct().count() == len(different)
    assert frame.select(fingerprint(7)).intersect(frame.select(fingerprint(14))).count() == 0
