"""Gradient-boosted challenger: the days after each series, by one model per series and target.

Kept for comparison with the ridge: it has the same features and the same recursion. All series
and targets are fitted in one job, each by a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.series import histories
from tallyhouse.operators.trees import TREES, boosted_paths
from tallyhouse.plans.backtest import SHORT
from tallyhouse.plans.forecast import whole_prediction
from tallyhouse.plans.methods import FITTED_HISTORY


def boosted_forecast(series: DataFrame, targets: Sequence[str] = ("net_sales_pence",),
                     horizon: int = 14, trees: int = TREES) -> DataFrame:
    """``series_id, target, date, predicted_value, status`` for the days after each series.

    A series shorter than `FITTED_HISTORY` days has one row per target with nulls and a status.
    """
    packed = histories(series, tuple(targets)).withColumn("origin", F.size("values"))
    enough = F.col("origin") >= FITTED_HISTORY
    paths = boosted_paths(packed.filter(enough).withColumn("origins", F.array("origin")),
                          horizon, trees)
    last = F.date_add("first_day", F.col("origin") - 1)
    # An outer join keeps the short series: they have no path and one row of nulls.
    joined = packed.select("series_id", "target", last.alias("last"), enough.alias("enough")).join(
        paths.select("series_id", "target", "forecast"), ["series_id", "target"], "left")
    return joined.select(
        "series_id", "target", "last", "enough", F.posexplode_outer("forecast").alias("at", "value")
    ).select(
        "series_id", "target", F.date_add("last", F.col("at") + 1).alias("date"),
        whole_prediction(F.col("value"), F.col("target")).alias("predicted_value"),
        F.when(F.col("enough"), F.lit("forecast")).otherwise(F.lit(SHORT)).alias("status"))
