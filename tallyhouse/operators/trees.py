"""Gradient-boosted trees by histograms, one small model per training window.

Spark holds the series, cuts the windows and spreads them over tasks; the functions below only
fit one window of daily values, like the ridge's. Loss is squared error, so every row's second
derivative is one and a leaf's weight is its residuals over its rows plus the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.features import MIN_HISTORY
from tallyhouse.operators.ridge import FLOORED, calendar_flags, trailing_levels
from tallyhouse.session import ship

# Depth, trees, learning rate, smallest leaf, leaf penalty, most bins a feature.
DEPTH, TREES, LEARNING_RATE, MIN_LEAF, PENALTY, BINS = 3, 200, 0.05, 10, 1.0, 255

FOLD_SCHEMA = (
    "series_id string, target string, origin int, forecast array<double>, actual array<double>"
)


@dataclass(frozen=True)
class Boosted:
    """Complete trees of `DEPTH`; a node that does not split sends all rows left."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    above: np.ndarray  # trees x inner nodes: rows over this value go right
    leaf: np.ndarray  # trees x leaves

    def predict(self, x: np.ndarray) -> float:
        tree, node = np.arange(len(self.leaf)), np.zeros(len(self.leaf), dtype=int)
        for _ in range(DEPTH):
            right = x[self.feature[tree, node]] > self.above[tree, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[tree, node - (2 ** DEPTH - 1)].sum()


def edges_of(column: np.ndarray) -> np.ndarray:
    """Split values between neighbouring distinct values, or quantiles of a column with many."""
    known = np.unique(column)
    if len(known) <= BINS:
        return (known[1:] + known[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, BINS) / BINS))


def _best_splits(sums: np.ndarray, rows: np.ndarray, starts: np.ndarray,
                 column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and cell of every node's best split, from (node, cell) histograms.

    A cell is a bin of a feature; ``starts`` are the features' first cells and ``column`` is the
    feature of each. The first cell wins among equal gains.
    """
    total, size = sums[:, :starts[1]].sum(axis=1), rows[:, :starts[1]].sum(axis=1)
    # Every feature's bins add up to the node, so running sums restart by the whole nodes before.
    left = sums.cumsum(axis=1) - column * total[:, None]
    count = rows.cumsum(axis=1) - column * size[:, None]
    right, other = total[:, None] - left, size[:, None] - count
    gain = left * left / (count + PENALTY) + right * right / (other + PENALTY)
    gain -= (total * total / (size + PENALTY))[:, None]
    # A feature's last bin leaves nothing on the other side and is out by the same test.
    gain[(count < MIN_LEAF) | (other < MIN_LEAF)] = 0.0
    at = gain.argmax(axis=1)
    return gain[np.arange(len(gain)), at], at


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Trees fitted one after another to what the earlier ones leave over."""
    n, width = x.shape
    edges = [edges_of(x[:, j]) for j in range(width)]
    bins = np.array([len(e) + 1 for e in edges])
    starts = np.concatenate([[0], bins.cumsum()])
    column, cells = np.repeat(np.arange(width), bins), int(starts[-1])
    values = np.concatenate([np.append(e, np.inf) for e in edges])
    cell = starts[:-1] + np.column_stack([
        np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    every = np.arange(n)
    feature = np.zeros((trees, 2 ** DEPTH - 1), dtype=int)
    above = np.full((trees, 2 ** DEPTH - 1), np.inf)
    leaf = np.zeros((trees, 2 ** DEPTH))
    base = float(y.mean())
    residual = y - base
    for tree in range(trees):
        weights, node = np.repeat(residual, width), np.zeros(n, dtype=int)
        for depth in range(DEPTH):
            nodes, first = 2 ** depth, 2 ** depth - 1
            keys = (node[:, None] * cells + cell).ravel()
            sums = np.bincount(keys, weights, nodes * cells).reshape(nodes, cells)
            rows = np.bincount(keys, minlength=nodes * cells).reshape(nodes, cells)
            gain, at = _best_splits(sums, rows, starts, column)
            split = gain > 0
            feature[tree, first:first + nodes] = np.where(split, column[at], 0)
            above[tree, first:first + nodes] = np.where(split, values[at], np.inf)
            cut = np.where(split, at, cells)
            node = 2 * node + (cell[every, column[at][node]] > cut[node])
        held = np.bincount(node, minlength=2 ** DEPTH)
        leaf[tree] = LEARNING_RATE * np.bincount(node, residual, 2 ** DEPTH) / (held + PENALTY)
        residual = residual - leaf[tree][node]
    return Boosted(base, feature, above, leaf)


def boosted_path(known: np.ndarray, first_day, horizon: int, floor: bool, trees: int = TREES,
                 months: bool = False, holidays: bool = True) -> np.ndarray:
    """Forecasts after the known days, each step fed its own predictions."""
    start, cut = np.datetime64(first_day, "D"), len(known)
    windows = np.lib.stride_tricks.sliding_window_view(known, MIN_HISTORY)[:-1]
    flags = calendar_flags(start + np.arange(MIN_HISTORY, cut + horizon), months, holidays)
    model = boost(np.hstack([trailing_levels(windows), flags[:cut - MIN_HISTORY]]),
                  known[MIN_HISTORY:], trees)
    trailing, path = known[-MIN_HISTORY:], np.empty(horizon)
    for step in range(horizon):
        x = np.concatenate([trailing_levels(trailing[None, :])[0], flags[cut - MIN_HISTORY + step]])
        value = model.predict(x)
        path[step] = max(value, 0.0) if floor else value
        trailing = np.append(trailing[1:], path[step])
    return path


def boosted_paths(histories: DataFrame, horizon: int, trees: int = TREES,
                  include_month: bool = False, include_holiday: bool = True,
                  tasks: int | None = None) -> DataFrame:
    """``series_id, target, origin, forecast, actual`` for each origin each row asks for.

    ``histories`` is that of the ridge. Every window is a row of its own, so the folds of one
    long series are fitted by many tasks. Origins need a day beyond the 28 of pure history.
    """
    windows = histories.select(
        "series_id", "target", "first_day", "values", F.explode("origins").alias("origin")
    ).filter(F.col("origin") > MIN_HISTORY).select(
        "series_id", "target", "first_day", "origin",
        F.slice("values", F.lit(1), F.col("origin")).alias("known"),
        F.slice("values", F.col("origin") + 1, F.lit(horizon)).alias("actual"))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [
                boosted_path(np.asarray(row.known, dtype=float), row.first_day, horizon,
                             row.target in FLOORED, trees, include_month, include_holiday)
                for row in batch.itertuples(index=False)]
            yield batch[["series_id", "target", "origin"]].assign(
                forecast=paths, actual=batch["actual"])

    spark = ship(histories.sparkSession)
    count = tasks or max(spark.sparkContext.defaultParallelism,
                         int(spark.conf.get("spark.sql.shuffle.partitions")))
    return windows.repartition(count, "series_id", "target", "origin").mapInPandas(fit, FOLD_SCHEMA)
