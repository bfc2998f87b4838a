"""Every registered query against its SQL, or for row shape where it has none."""

from pathlib import Path

import pytest

import __spark_entry__ as registry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
OWN = set(registry._registry())
QUERIES = {name: run for name, run in registry.queries().items() if name in OWN}
SQL = {name: sql for name, sql in registry.oracle_sql().items() if name in OWN}
# Fitted models have no SQL; the forecasting tests check them against plain Python.
FITTED = {"ridge_backtest", "full_backtest", "forecast", "forecast_totals", "boosted_forecast"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(SQL) == FITTED and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None


def test_entry_has_one_row(spark):
    assert registry.entry(spark).count() == 1
