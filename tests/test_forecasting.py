"""Series, features, baselines, ridge and backtest, against plain Python where fitted."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tallyhouse.operators import baselines, features, ridge, scoring, trees
from tallyhouse.operators import series as ops
from tallyhouse.plans import backtest, boosting, forecast, methods
from tests.test_orders import rows

WEEKLY = [90, 140, 125, 160, 230, 390, 305]
SERIES = "series_id string, day date, net_sales_pence long, payment_order_count long, net_units long"
MONDAY = date(2026, 1, 5)


def daily(spark, values, first=MONDAY, name="s"):
    return spark.createDataFrame(
        [(name, first + timedelta(days=i), int(v), abs(int(v)) // 10, int(v) // 5)
         for i, v in enumerate(values)], SERIES)


def noisy(n, seed=7):
    rng = np.random.default_rng(seed)
    shape = np.array([WEEKLY[i % 7] for i in range(n)]) * 100
    return (shape * rng.normal(1, 0.15, n) + np.arange(n) * 5).astype(int)


# --- series -----------------------------------------------------------------------------


def test_daily_series_fills_quiet_days_between_first_and_last(shop):
    shop.order("2026-03-28 12:00", net=100)
    shop.order("2026-03-29 23:30", net=50)
    shop.order("2026-04-01 00:30", net=-70, event="refund", units=-1)
    got = ops.daily_series(shop.orders)
    assert sorted(rows(got, "day", *ops.TARGETS)) == [
        (date(2026, 3, 28), 100, 1, 1), (date(2026, 3, 29), 50, 1, 1),
        (date(2026, 3, 30), 0, 0, 0), (date(2026, 3, 31), 0, 0, 0),
        (date(2026, 4, 1), -70, 0, -1)]
    traded = got.filter(ops.traded()).count()
    assert traded == 3
    last_two = ops.daily_series(shop.orders, training_days=2)
    assert sorted(rows(last_two, "day", "net_units")) == [
        (date(2026, 3, 31), 0), (date(2026, 4, 1), -1)]


def test_each_key_is_its_own_series(shop):
    shop.order("2026-03-01 12:00", channel="online")
    shop.order("2026-03-03 12:00", channel="online")
    shop.order("2026-03-05 12:00", channel="mixed")
    counts = ops.daily_series(shop.orders, series="channel").groupBy("series_id").count()
    assert dict(rows(counts, "series_id", "count")) == {"online": 3, "mixed": 1}


def test_violations_are_named_and_raise(spark):
    bad = spark.createDataFrame(
        [("a", MONDAY, 1, 1, 1), ("a", MONDAY, 1, 1, 1), ("a", MONDAY + timedelta(4), 1, -1, 1),
         ("b", MONDAY, 1, None, 1)], SERIES)
    problems = {(r["series_id"], r["problem"])
                for r in ops.series_violations(bad, 3).collect()}
    assert problems == {("a", "duplicate date"), ("a", "3-day gap before this day"),
                        ("a", "negative order count"), ("b", "missing value"),
                        ("b", "only 1 day(s), 3 required")}
    with pytest.raises(ops.SeriesIntegrityError, match="duplicate date"):
        ops.validate_series(bad)
    good = daily(spark, WEEKLY)
    assert ops.validate_series(good, 7) is good
    with pytest.raises(ops.SeriesIntegrityError, match="empty"):
        ops.validate_series(good.limit(0))


def test_features_read_only_the_past(spark):
    values = noisy(60)
    matrix = features.design_matrix(daily(spark, values), True, True).filter(
        "target = 'net_sales_pence'")
    got = {r["day"]: r for r in matrix.collect()}
    assert min(got) == MONDAY + timedelta(28) and len(got) == 32
    for t in (28, 40, 59):
        row = got[MONDAY + timedelta(t)]
        assert [row[f"lag_{k}"] for k in (7, 14, 21, 28)] == [values[t - k]
                                                             for k in (7, 14, 21, 28)]
        assert row["trailing_mean_7"] == pytest.approx(values[t - 7:t].mean())
        assert row["trailing_mean_28"] == pytest.approx(values[t - 28:t].mean())
        weekday = (MONDAY + timedelta(t)).weekday()
        assert [row[f"weekday_{d}"] for d in range(1, 7)] == [float(weekday == d)
                                                              for d in range(1, 7)]
    changed = values.copy()
    changed[50] += 10 ** 6
    after = {r["day"]: r for r in features.design_matrix(
        daily(spark, changed), True, True).filter("target = 'net_sales_pence'").collect()}
    same = [d for d in got if got[d] == after[d]]
    assert max(same) == MONDAY + timedelta(49)
    names = features.feature_names(True, True)
    assert set(names) <= set(matrix.columns) and len(names) == 24


def test_fixed_holidays(spark):
    span = daily(spark, range(60), first=date(2026, 11, 10))
    flagged = features.design_matrix(span, include_holiday=True).filter(
        "is_fixed_holiday = 1 AND target = 'net_units'")
    assert sorted(r["day"] for r in flagged.collect()) == [
        date(2026, 12, 25), date(2026, 12, 26), date(2027, 1, 1)]


# --- baselines and scores ---------------------------------------------------------------


def test_baselines_by_hand(spark):
    history = [float(v) for v in range(1, 36)]
    frame = spark.createDataFrame([(history,)], "h array<double>")

    def run(method, horizon):
        return frame.select(method(F.col("h"), horizon)).first()[0]

    assert run(baselines.seasonal_naive, 9) == [29, 30, 31, 32, 33, 34, 35, 29, 30]
    assert run(baselines.same_weekday_mean, 2) == [(29 + 22 + 15 + 8) / 4, (30 + 23 + 16 + 9) / 4]
    assert run(baselines.trailing_mean, 2) == [sum(range(8, 36)) / 28] * 2
    short = spark.createDataFrame([([float(v) for v in range(1, 15)],)], "h array<double>")
    assert short.select(baselines.same_weekday_mean(F.col("h"), 1)).first()[0] == [(8 + 1) / 2]


def test_scores(spark):
    frame = spark.createDataFrame(
        [("s", "a", [10.0, 20.0], [12.0, 17.0]), ("s", "b", [0.0], [5.0]),
         ("s", "c", [10.0], [9.0]), ("s", "c", [1000.0], [1300.0])],
        "series_id string, method string, actual array<double>, forecast array<double>")
    got = {r["method"]: r for r in scoring.pooled(
        scoring.score_totals(frame), "series_id", "method").collect()}
    assert (got["a"]["mae"], got["a"]["wape_percent"]) == (2.5, pytest.approx(500 / 30))
    assert (got["b"]["mae"], got["b"]["wape_percent"]) == (5.0, None)
    # Pooled from totals: the mean of the two rates would be 20.
    assert got["c"]["wape_percent"] == pytest.approx(301 / 1010 * 100)
    ranked = spark.createDataFrame(
        [("s", "t", "x", None), ("s", "t", "y", 5.0), ("s", "t", "z", 1.0)],
        "series_id string, target string, method string, wape_percent double")
    assert rows(scoring.ranked_methods(ranked), "method") == [("z",), ("y",), ("x",)]


def test_fold_schedule(spark):
    long = daily(spark, range(365))
    got = rows(backtest.folds(long), "fold", "origin", "first_test_day", "last_test_day")
    assert len(got) == 17
    assert got[0] == (0, 120, MONDAY + timedelta(120), MONDAY + timedelta(133))
    assert got[-1][1] == 344
    assert backtest.folds(daily(spark, range(134))).count() == 1
    assert backtest.folds(daily(spark, range(133))).count() == 0
    assert backtest.folds(long, step=7).count() == 34
    with pytest.raises(ValueError):
        backtest.folds(long, step=0)
    days = ops.forecast_days(daily(spark, range(10)), 3)
    assert sorted(rows(days, "step", "day")) == [
        (s, MONDAY + timedelta(9 + s)) for s in (1, 2, 3)]


def test_weekly_shape_is_exact_for_seasonal_methods(spark):
    scored = backtest.evaluate(backtest.baseline_folds(daily(spark, WEEKLY * 25)))
    money = {r["method"]: r for r in scored.filter("target = 'net_sales_pence'").collect()}
    assert money["seasonal_naive"]["mae"] == 0 and money["same_weekday_mean_4"]["mae"] == 0
    assert money["trailing_mean_28"]["mae"] > 50
    assert money["seasonal_naive"]["folds"] == 3 and money["seasonal_naive"]["days"] == 42


# --- ridge -------------------------------------------------------------------------------


def slow_row(history, day):
    """One feature row, written out the long way."""
    row = [1.0 if day.weekday() == d else 0.0 for d in range(1, 7)]
    row += [history[-7], history[-14], history[-21], history[-28]]
    row += [sum(history[-7:]) / 7, sum(history[-28:]) / 28]
    row.append(1.0 if (day.month, day.day) in {(12, 25), (12, 26), (1, 1)} else 0.0)
    return np.array(row, dtype=float)


def slow_ridge(values, first, alpha, horizon, floor):
    """Ridge with a free intercept as an augmented least-squares problem, then recursion."""
    x = np.array([slow_row(list(values[:t]), first + timedelta(t))
                  for t in range(28, len(values))])
    y = np.array(values[28:], dtype=float)
    mean, std = x[:, 6:12].mean(0), x[:, 6:12].std(0)
    std[std == 0] = 1

    def scaled(r):
        r = r.copy()
        r[6:12] = (r[6:12] - mean) / std
        return r

    z = np.array([scaled(r) for r in x])
    middle = z.mean(0)
    top = np.vstack([z - middle, np.sqrt(alpha) * np.eye(z.shape[1])])
    w = np.linalg.lstsq(top, np.concatenate([y - y.mean(), np.zeros(z.shape[1])]), rcond=None)[0]
    known, out = [float(v) for v in values], []
    for step in range(horizon):
        p = y.mean() + (scaled(slow_row(known, first + timedelta(len(values) + step)))
                        - middle) @ w
        p = max(p, 0.0) if floor else p
        out.append(p)
        known.append(p)
    return out


def slow_choice(values, first, horizon, floor):
    errors = {}
    for alpha in ridge.ALPHAS:
        gaps = []
        for k in (3, 2, 1):
            cut = len(values) - k * horizon
            if cut > 28 + horizon:
                path = slow_ridge(values[:cut], first, alpha, horizon, floor)
                gaps += [abs(a - p) for a, p in zip(values[cut:cut + horizon], path)]
        if gaps:
            errors[alpha] = sum(gaps) / len(gaps)
    return min(errors, key=lambda a: (errors[a], -a)) if errors else max(ridge.ALPHAS)


@pytest.mark.parametrize("target", ["net_sales_pence", "net_units"])
def test_ridge_folds_match_the_long_way(spark, target):
    frame = daily(spark, noisy(176))
    values = [r[target] for r in frame.orderBy("day").collect()]
    got = backtest.ridge_folds(frame, targets=(target,)).collect()
    assert sorted(r["origin"] for r in got) == [120, 134, 148, 162]
    for r in got:
        train = values[:r["origin"]]
        floor = target == "net_units"
        alpha = slow_choice(train, MONDAY, 14, floor)
        assert r["forecast"] == pytest.approx(
            slow_ridge(train, MONDAY, alpha, 14, floor), rel=1e-6)
        assert r["actual"] == values[r["origin"]:r["origin"] + 14]


def test_ridge_with_other_steps_and_horizons(spark):
    values = noisy(150)
    frame = daily(spark, values)
    got = backtest.ridge_folds(frame, horizon=10, first=110, step=7,
                               targets=("net_sales_pence",)).collect()
    assert sorted(r["origin"] for r in got) == [110, 117, 124, 131, 138]
    for r in got:
        train = list(values[:r["origin"]])
        alpha = slow_choice(train, MONDAY, 10, False)
        assert r["forecast"] == pytest.approx(slow_ridge(train, MONDAY, alpha, 10, False), rel=1e-6)


def test_changing_the_future_changes_no_forecast(spark):
    values = noisy(150)
    changed = values.copy()
    changed[125:] = 10 ** 7
    first = {}
    for v in (values, changed):
        folded = backtest.ridge_folds(daily(spark, v)).unionByName(
            backtest.baseline_folds(daily(spark, v)))
        for r in folded.filter("origin = 120").collect():
            key = (r["target"], r["method"])
            assert first.setdefault(key, r["forecast"]) == r["forecast"]
    assert len(first) == 12


def test_short_history_takes_the_strongest_penalty(spark):
    frame = ops.histories(daily(spark, noisy(45)), ("net_sales_pence",)).withColumn(
        "origins", F.array(F.size("values")))
    chosen = ridge.selected_paths(ridge.forecast_paths(frame, 14), 14).first()
    assert chosen["alpha"] == 100.0


def test_counts_are_floored_and_money_is_not(spark):
    falling = [10000 - 150 * i for i in range(140)]
    got = backtest.ridge_folds(daily(spark, falling), targets=("net_sales_pence", "net_units"))
    lowest = dict(rows(got.groupBy("target").agg(F.min(F.array_min("forecast")).alias("m")),
                       "target", "m"))
    assert lowest["net_units"] == 0.0 and lowest["net_sales_pence"] < 0


def test_forecast_service(spark):
    both = daily(spark, noisy(200), name="a").unionByName(daily(spark, noisy(150, 3), name="b"))
    got = forecast.forecast(both, ("net_sales_pence", "payment_order_count"), horizon=5)
    assert got.count() == 20
    one = got.filter("series_id = 'b' AND target = 'net_sales_pence'").orderBy("date").collect()
    last = MONDAY + timedelta(149)
    assert [r["date"] for r in one] == [last + timedelta(d) for d in range(1, 6)]
    values = list(noisy(150, 3))
    expected = slow_ridge(values, MONDAY, slow_choice(values, MONDAY, 5, False), 5, False)
    assert [r["predicted_value"] for r in one] == [round(p) for p in expected]
    row = one[0]
    assert (row["trained_through"], row["forecast_end"], row["unit"], row["method"],
            row["backtest_folds"], row["evaluated_days"]) == (
        last, last + timedelta(5), "pence", "ridge_holiday", 2, 28)
    assert 0 < row["historical_wape_percent"] < 60
    totals = dict(rows(scoring.forecast_total(got.filter("target = 'net_sales_pence'")),
                       "series_id", "forecast_total"))
    assert totals["b"] == sum(r["predicted_value"] for r in one)

    with pytest.raises(forecast.InsufficientHistory, match="133 day"):
        forecast.forecast(daily(spark, noisy(133)), strict=True)
    with pytest.raises(ValueError):
        forecast.forecast(both, horizon=15)
    with pytest.raises(ValueError):
        forecast.forecast(both, ("profit",))


def test_short_series_stop_no_other_and_have_a_row(spark):
    mixed = daily(spark, noisy(150)).withColumn("series_id", F.lit("long")).unionByName(
        daily(spark, noisy(60)).withColumn("series_id", F.lit("short")))
    assert rows(backtest.short_series(mixed), "series_id", "days", "required_days") == [
        ("short", 60, 134)]
    assert sorted(rows(backtest.series_status(mixed), "series_id", "days", "folds", "status")) == [
        ("long", 150, 2, "evaluated"), ("short", 60, 0, "insufficient_history")]
    got = forecast.forecast(mixed, with_accuracy=False).collect()
    assert [(r["target"], r["predicted_value"], r["status"]) for r in got if r["series_id"] == "short"] == [
        ("net_sales_pence", None, "insufficient_history")]
    assert len(got) == 15 and all(r["status"] == "evaluated" for r in got if r["series_id"] == "long")
    scored = backtest.run_backtest(mixed, targets=("net_units",))
    assert sorted(rows(scored, "series_id", "method", "status"), key=str) == [
        ("long", "ridge_holiday", "evaluated"), ("long", "same_weekday_mean_4", "evaluated"),
        ("long", "seasonal_naive", "evaluated"), ("long", "trailing_mean_28", "evaluated"),
        ("short", None, "insufficient_history")]


def test_predictions_round_half_to_even(spark):
    frame = spark.createDataFrame([(2.5, "net_units"), (3.5, "net_units"), (-0.4, "net_units"),
                                   (-2.5, "net_sales_pence")], "v double, t string")
    got = [r[0] for r in frame.select(
        forecast.whole_prediction(F.col("v"), F.col("t"))).collect()]
    assert got == [2, 4, 0, -2]


def test_backtest_report(spark):
    got = backtest.run_backtest(daily(spark, noisy(150)), targets=("net_sales_pence",))
    assert sorted(rows(got, "method", "folds")) == [
        ("ridge_holiday", 2), ("same_weekday_mean_4", 2), ("seasonal_naive", 2),
        ("trailing_mean_28", 2)]
    per_fold = backtest.fold_scores(backtest.baseline_folds(daily(spark, noisy(150))))
    assert per_fold.count() == 2 * 3 * 3
    with pytest.raises(ops.SeriesIntegrityError, match="134 required"):
        backtest.run_backtest(daily(spark, range(100)), strict=True)
    with pytest.raises(ops.SeriesIntegrityError, match="same_weekday_mean_4 needs 28"):
        backtest.baseline_folds(daily(spark, range(200)), first=20)


def test_boosted_challenger_follows_the_week(spark):
    got = boosting.boosted_forecast(daily(spark, WEEKLY * 12), horizon=7, trees=30)
    values = [r["predicted_value"] for r in got.orderBy("date").collect()]
    assert len(values) == 7 and values[5] > values[0]


def test_registered_forecasts_are_the_whole_job(spark, monkeypatch):
    monkeypatch.setattr(registry, "_nations", lambda s, d: daily(spark, noisy(140)))
    totals = registry.queries()["forecast_totals"](spark, "")
    assert {r["target"] for r in totals.collect()} == set(ops.TARGETS)

    got = registry.queries()["boosted_forecast"](spark, "").groupBy("target").count()
    assert dict(rows(got, "target", "count")) == {t: 14 for t in ops.TARGETS}
    assert trees.TREES == 200


def plain_boost(x, y, count):
    """The same trees by trying every split of every node on the rows themselves."""
    edges = [trees.edges_of(x[:, j]) for j in range(x.shape[1])]

    def grow(at, residual, depth):
        def score(part):
            return residual[part].sum() ** 2 / (len(part) + 1.0)

        best, split = 1e-9, None
        for j in range(x.shape[1]) if depth else ():
            for edge in edges[j]:
                low, high = at[x[at, j] <= edge], at[x[at, j] > edge]
                if min(len(low), len(high)) >= 10:
                    gain = score(low) + score(high) - score(at)
                    if gain > best * (1 + 1e-9):
                        best, split = gain, (j, edge, low, high)
        if split is None:
            value = 0.05 * residual[at].sum() / (len(at) + 1.0)
            fitted[at] += value
            return value
        j, edge, low, high = split
        return j, edge, grow(low, residual, depth - 1), grow(high, residual, depth - 1)

    fitted, grown = np.full(len(y), y.mean()), []
    for _ in range(count):
        grown.append(grow(np.arange(len(y)), y - fitted, 3))

    def predict(row):
        def walk(tree):
            return walk(tree[2 if row[tree[0]] <= tree[1] else 3]) if isinstance(tree, tuple) else tree
        return y.mean() + sum(walk(tree) for tree in grown)

    return predict


def test_boosted_trees_agree_with_a_plain_implementation():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=90), rng.integers(0, 2, 90), rng.normal(size=90).round(1)])
    y = 3 * x[:, 0] + 2 * x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 90)
    model, plain = trees.boost(x, y, 20), plain_boost(x, y, 20)
    assert [model.predict(r) for r in x] == pytest.approx([plain(r) for r in x], abs=1e-9)
    flat = trees.boost(x, np.full(90, 4.0), 5)
    assert flat.predict(x[0]) == 4.0
    tiny = trees.boost(x[:5], y[:5], 5)
    assert tiny.predict(x[0]) == pytest.approx(y[:5].mean())


def test_boosted_forecast_has_rows_for_short_series(spark):
    both = daily(spark, noisy(60), name="long").unionByName(daily(spark, noisy(20), name="short"))
    got = boosting.boosted_forecast(both, horizon=3, trees=5)
    counts = got.groupBy("series_id", "status").agg(F.count("predicted_value").alias("n"))
    assert sorted(rows(counts, "series_id", "status", "n")) == [
        ("long", "forecast", 3), ("short", "insufficient_history", 0)]


def test_backtest_takes_registered_and_own_methods(spark):
    last = methods.Method("last_day", 1, expression=lambda known, horizon: F.array_repeat(
        F.element_at(known, -1).cast("double"), horizon))
    values = noisy(150)
    asked = ["seasonal_naive", "ridge_month_holiday", "gradient_boosting", last]
    asked[0] = next(iter(baselines.BASELINES))
    got = backtest.run_backtest(daily(spark, values), targets=["net_sales_pence"], methods=asked)
    found = {r["method"]: r for r in got.collect()}
    assert set(found) == {asked[0], "ridge_month_holiday", "gradient_boosting", "last_day"}
    assert {r["folds"] for r in found.values()} == {2}
    expected = sum(abs(int(v) - int(values[o - 1]))
                   for o in (120, 134) for v in values[o:o + 14])
    assert found["last_day"]["absolute_error_total"] == pytest.approx(expected)
    path = trees.boosted_path(np.asarray(values[:120], dtype=float), MONDAY, 14, False)
    second = trees.boosted_path(np.asarray(values[:134], dtype=float), MONDAY, 14, False)
    assert found["gradient_boosting"]["absolute_error_total"] == pytest.approx(
        np.abs(np.concatenate([path, second]) - values[120:148]).sum())


def test_methods_are_checked(spark):
    with pytest.raises(ValueError, match="unknown methods"):
        backtest.run_backtest(daily(spark, WEEKLY), methods=["oracle"])
    with pytest.raises(ValueError, match="distinct"):
        backtest.run_backtest(daily(spark, WEEKLY), methods=["ridge_holiday"] * 2)
    with pytest.raises(ValueError, match="registered already"):
        methods.register(methods.METHODS["ridge_holiday"])
    with pytest.raises(ValueError, match="either"):
        methods.Method("nothing", 1)
