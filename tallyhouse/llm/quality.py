"""Quality scores by a factorisation machine over words, structure and metadata.

A text's features are its hashed words, statistics of its make-up and its metadata. The
machine adds a weight for each feature and, for each pair of features, the product of their
factor vectors; the pair terms are summed in linear time as half of (sum squared minus sum of
squares) per factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.wordstream import pieces, text_buffers, words_of
from tallyhouse.session import ship

WORD_BITS = 14
FACTORS = 8
# Kinds of bytes: other, lower case, upper case, digit, space, line end, symbol, above ASCII.
_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9),
                                (10, 13), [*range(33, 48), *range(58, 65), *range(91, 97),
                                           *range(123, 127)], range(128, 256)), 1):
    _KINDS[list(_bytes)] = _kind
STATISTICS = 8 + 7


class Features(NamedTuple):
    """Sparse rows: feature numbers, values, row bounds. Statistics follow the words' numbers."""

    at: np.ndarray
    value: np.ndarray
    bounds: np.ndarray


class Machine(NamedTuple):
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def _described(texts: pa.Array, n_chars: pa.Array):
    """(word features, statistics by text)."""
    n = len(texts)
    data, offsets = text_buffers(texts)
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + _KINDS[data], minlength=8 * n)
    shares = kinds.reshape(n, 8) / np.maximum(size, 1)[:, None]
    words = words_of(texts, fold=True)
    count = np.diff(words.bounds)
    slot = (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, times = np.unique((words.text << WORD_BITS) | slot, return_counts=True)
    row, at = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    bounds = np.searchsorted(row, np.arange(n + 1))
    value = np.sqrt(times / np.maximum(count, 1)[row])
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    length = np.zeros(n)
    np.add.at(length, words.text, words.end - words.start)
    given = np.asarray(n_chars.cast(pa.float64()).fill_null(np.nan), dtype=float)
    per_word = np.maximum(count, 1)
    statistics = np.column_stack([
        shares, np.log1p(size), np.log1p(count), length / per_word,
        np.diff(bounds) / per_word, most / per_word,
        np.log1p(np.maximum(np.nan_to_num(given), 0)), np.isnan(given)])
    return Features(at, value, bounds), statistics


def _joined(words: Features, statistics: np.ndarray, centre, spread) -> Features:
    """Words and standardised statistics in one sparse matrix."""
    n, k = statistics.shape
    scaled = np.clip((statistics - centre) / spread, -4, 4) / np.sqrt(k)
    row = np.concatenate([np.repeat(np.arange(n), np.diff(words.bounds)), np.repeat(np.arange(n), k)])
    order = np.argsort(row, kind="stable")
    at = np.concatenate([words.at, np.tile((1 << WORD_BITS) + np.arange(k), n)])[order]
    value = np.concatenate([words.value, scaled.ravel()])[order]
    return Features(at, value, words.bounds + k * np.arange(n + 1))


def _margins(machine: Machine, x: Features) -> tuple[np.ndarray, np.ndarray]:
    """(margin by row, factor sums by row). No row is empty: each has the statistics."""
    own = machine.factor[x.at] * x.value[:, None]
    sums = np.add.reduceat(own, x.bounds[:-1], axis=0)
    squares = np.add.reduceat((own * own).sum(axis=1), x.bounds[:-1])
    linear = np.add.reduceat(machine.weight[x.at] * x.value, x.bounds[:-1])
    return machine.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _fitted(words: Features, statistics: np.ndarray, label: np.ndarray, epochs: int = 12,
            batch: int = 128, step: float = 0.02, decay: float = 1e-4) -> Machine:
    """Logistic loss by Adam over shuffled batches; the seed is fixed."""
    draw = np.random.default_rng(7)
    n, width = len(label), (1 << WORD_BITS) + statistics.shape[1]
    centre, spread = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
    x = _joined(words, statistics, centre, spread)
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    values = np.concatenate([np.zeros((width, 1)), draw.normal(0, 0.05, (width, FACTORS))], axis=1)
    bias, first, second, turn = np.log(rate / (1 - rate)), np.zeros_like(values), np.zeros_like(values), 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for begin in range(0, n, batch):
            rows = order[begin: begin + batch]
            sizes = x.bounds[rows + 1] - x.bounds[rows]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(x.bounds[rows] - ends[:-1], sizes) + np.arange(ends[-1])
            part = Features(x.at[pick], x.value[pick], ends)
            machine = Machine(bias, values[:, 0], values[:, 1:], centre, spread)
            margin, sums = _margins(machine, part)
            off = (_probability(margin) - label[rows]) / len(rows)
            each = np.repeat(off, sizes) * part.value
            pull = np.concatenate([
                each[:, None], each[:, None] * (np.repeat(sums, sizes, axis=0)
                                                - values[part.at, 1:] * part.value[:, None])], axis=1)
            used, where = np.unique(part.at, return_inverse=True)
            slope = np.zeros((len(used), FACTORS + 1))
            np.add.at(slope, where, pull)
            slope += decay * values[used]
            turn += 1
            first[used] = 0.9 * first[used] + 0.1 * slope
            second[used] = 0.999 * second[used] + 0.001 * slope * slope
            values[used] -= step * (first[used] / (1 - 0.9 ** turn)) / (
                np.sqrt(second[used] / (1 - 0.999 ** turn)) + 1e-8)
            bias -= step * off.sum()
    return Machine(bias, values[:, 0].copy(), values[:, 1:].copy(), centre, spread)


def _describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, statistics = _described(piece.column("text"), piece.column("n_chars"))
            bounds = pa.array(words.bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), piece.column("label"),
                 pa.ListArray.from_arrays(bounds, pa.array(words.at, pa.int32())),
                 pa.ListArray.from_arrays(bounds, pa.array(words.value)),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(piece.num_rows + 1) * STATISTICS, pa.int32()),
                     pa.array(statistics.ravel()))],
                names=["key", "label", "at", "value", "statistics"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                label_col: str = "quality", sample: int = 6000) -> Machine | None:
    """A machine from at most `sample` labelled documents, those whose hashed id comes first.

    `docs` has the id, text and n_chars. Null labels and labels without a document teach
    nothing; of an id labelled twice, the smaller label counts. None if nothing is left.
    """
    ship(docs.sparkSession)
    chosen = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(
        F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample)
    known = docs.select(F.col(id_col).alias("key"), "text", "n_chars").join(
        F.broadcast(chosen), "key")  # at most `sample` rows of two numbers
    kind = docs.schema[id_col].dataType.simpleString()
    rows = known.mapInArrow(
        _describer, f"key {kind}, label int, at array<int>, value array<double>,"
        " statistics array<double>").toPandas().sort_values("key")
    if rows.empty:
        return None
    bounds = np.concatenate([[0], np.cumsum(rows["at"].map(len))])
    words = Features(np.concatenate(rows["at"].to_list()).astype(np.int64),
                     np.concatenate(rows["value"].to_list()).astype(float), bounds)
    return _fitted(words, np.stack(rows["statistics"].to_list()), rows["label"].to_numpy(float))


def _scorer(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, statistics = _described(piece.column("text"), piece.column("n_chars"))
                x = _joined(words, statistics, machine.centre, machine.spread)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(_probability(_margins(machine, x)[0]))],
                    names=["doc", "score"])
    return run


def score_quality(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id",
                  text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """One row per row: id, score (chance of label 1), predicted.

    Null and empty texts are scored by their statistics, a null `n_chars` is a feature of its
    own, null ids and repeated rows are scored like others. Without a machine every score is
    0.5. Columns not named are not read.
    """
    ship(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"),
                       F.col(chars_col).alias("n_chars"))
    if machine is None:
        scored = read.select("doc", F.lit(0.5).alias("score"))
    else:
        scored = read.mapInArrow(_scorer(machine), T.StructType(
            [read.schema["doc"], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("doc").alias(id_col), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
