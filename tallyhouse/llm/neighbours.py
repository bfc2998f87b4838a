"""Nearest vectors by inner product, over several shifted Hilbert curves.

Each ordering rotates the vectors at random, shifts them, and numbers them along a Hilbert
curve through a few of the rotated coordinates; what is near in space is near in at least
some of the orderings. Spark deals every ordering by key ranges: a task holds the queries of
one range and streams the rows of that range and of a window on either side past them. The
best of all orderings are merged and ranked by their exact products.

The window is measured: the true neighbours of a few queries are found by brute force, and
the window is made wide enough for `RECALL` of them. Data with structure needs narrow
windows; for directions without any, windows of several hundredths of all rows are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch

ORDERINGS = 12
AXES, BITS = 8, 8
BLOCK_ROWS = 512
PART_BLOCKS = 16
RECALL = 0.97
FIT_ROWS = 20_000
TRIAL_QUERIES = 128


class Curves(NamedTuple):
    """Per ordering: rotation, centre, spread, shift; key bounds of the blocks. Vectors get one
    more coordinate that makes all as long as `reach`, so that nearness follows the product."""

    reach: float
    rotation: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    shift: np.ndarray
    bounds: list[np.ndarray]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (rows) with coordinates below 2**bits."""
    x = cells.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > one:  # undo the turns of the finer cubes, from the coarsest on
        low = q - one
        for i in range(n):
            swap = np.where(x[i] & q, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & q, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > one:
        turn ^= np.where(x[n - 1] & q, q - one, np.uint64(0))
        q >>= one
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(bit)) & one)
    return key


def _keys(curves: Curves, vectors: np.ndarray, ordering: int) -> np.ndarray:
    rest = np.sqrt(np.maximum(curves.reach ** 2 - (vectors ** 2).sum(axis=1), 0))
    flat = np.column_stack([vectors, rest]) @ curves.rotation[ordering]
    flat = (flat - curves.centre[ordering]) / curves.spread[ordering] + curves.shift[ordering]
    cells = np.clip(flat / 10 + 0.5, 0, 1 - 1e-9) * (1 << BITS)
    return hilbert_keys(cells.astype(np.uint64), BITS)


def _fitted(sample: np.ndarray, reach: float, rows: int) -> Curves:
    draw = np.random.default_rng(11)
    width = sample.shape[1] + 1
    axes = min(AXES, width)
    rotation = np.stack([np.linalg.qr(draw.normal(size=(width, width)))[0][:, :axes]
                         for _ in range(ORDERINGS)])
    flat = np.einsum("nd,hda->hna", np.column_stack(
        [sample, np.sqrt(np.maximum(reach ** 2 - (sample ** 2).sum(axis=1), 0))]), rotation)
    curves = Curves(reach, rotation, flat.mean(axis=1), flat.std(axis=1) + 1e-12,
                    draw.uniform(-1, 1, (ORDERINGS, axes)), [])
    blocks = max(1, rows // BLOCK_ROWS)
    for h in range(ORDERINGS):
        keys = np.sort(_keys(curves, sample, h))
        curves.bounds.append(keys[(np.arange(1, blocks) * len(keys)) // blocks])
    return curves


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _indexer(curves: Curves):
    """Adds the block of every vector in every ordering."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"))
            blocks = np.column_stack([
                np.searchsorted(curves.bounds[h], _keys(curves, vectors, h), "right")
                for h in range(ORDERINGS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * ORDERINGS, pa.int32()),
                pa.array(blocks.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], names=[*batch.schema.names, "blocks"])
    return run


class _Best:
    """The running `k` best rows of each query: larger product, then smaller id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        products = self.queries @ vectors.T
        row, at = np.nonzero(products >= self.score[:, -1:] - 1e-9)
        if not len(row):
            return
        if len(row) > 4 * products.shape[0] * self.k and products.shape[1] > 4 * self.k:
            cut = np.partition(products, -2 * self.k, axis=1)[:, -2 * self.k]
            row, at = np.nonzero(products >= np.maximum(cut[:, None], self.score[:, -1:] - 1e-9))
        # Sums in one fixed order, so that a pair has one product wherever it is met.
        exact = (self.queries[row] * vectors[at]).sum(axis=1)
        who = np.concatenate([np.repeat(np.arange(len(self.queries)), self.k), row])
        score = np.concatenate([self.score.ravel(), exact])
        name = np.concatenate([self.id.ravel(), ids[at]])
        order = np.lexsort([name, -score, who])
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        kept = order[place < self.k]
        self.score = score[kept].reshape(-1, self.k)
        self.id = name[kept].reshape(-1, self.k)

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        real = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, self.k).reshape(real.shape)[real]),
             pa.array(self.id[real]), pa.array(self.score[real])], names=["q", "c", "score"])


def _searcher(k: int):
    """Rows come sorted by ordering and part, a part's queries before its candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, waiting, best = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([np.asarray(batch.column(c)) for c in ("ordering", "part", "side")])
            edges = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                ids = np.asarray(batch.column("pid"))[a:b]
                vectors = _matrix(batch.column("v").slice(a, b - a))
                if place != tuple(where[:2, a]):
                    if best is not None:
                        yield best.rows(np.concatenate(names))
                    place, names, waiting, best = tuple(where[:2, a]), [], [], None
                if where[2, a] == 0:
                    names.append(ids)
                    waiting.append(vectors)
                elif names:
                    if best is None:
                        best = _Best(np.concatenate(waiting), k)
                    for at in range(0, len(ids), 4096):
                        best.meet(ids[at: at + 4096], vectors[at: at + 4096])
        if best is not None:
            yield best.rows(np.concatenate(names))
    return run


def _trial(names: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k)
        for batch in batches:
            ids, vectors = np.asarray(batch.column("pid")), _matrix(batch.column("v"))
            for at in range(0, len(ids), 4096):
                best.meet(ids[at: at + 4096], vectors[at: at + 4096])
        yield best.rows(names)
    return run


def _top(frame: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return frame.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _window_blocks(points: DataFrame, asked: DataFrame, k: int) -> int:
    """Blocks on either side that hold `RECALL` of the true neighbours of a few queries."""
    trial = asked.orderBy(F.xxhash64("pid"), "pid").limit(TRIAL_QUERIES).select(
        "pid", "v", "blocks").toPandas()
    found = points.select("pid", "v").mapInArrow(
        _trial(trial["pid"].to_numpy(), np.stack(trial["v"].to_list()).astype(float), k),
        "q long, c long, score double")
    true = _top(found, k).join(points.select(F.col("pid").alias("c"), "blocks"), "c").select(
        "q", "blocks").toPandas()
    own = dict(zip(trial["pid"], trial["blocks"]))
    gap = np.array([np.abs(np.asarray(b) - np.asarray(own[q])).min()
                    for q, b in zip(true["q"], true["blocks"])])
    return int(np.ceil(np.quantile(gap, RECALL))) if len(gap) else 0


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """For each id divisible by `every`, the `k` nearest other rows found: query_id, rank,
    the id column, score.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that
    are null, empty, zero, hold null or non-finite components or have another length than
    most take no part, nor do null ids; rows that repeat an id count once, with the smallest
    vector. If there are fewer candidates, all are returned. Equal vectors are one point of
    the index with its first k + 1 ids, which is all that any query can want of it. Other
    columns are not read. Curves are fitted on at most 20,000 rows; every row is indexed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    # Single precision stays as it is, all else is compared as doubles.
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    sound = vectors.select(F.col(id_col).cast("long").alias("id"),
                           F.col(vector_col).cast(kind).alias("v")).filter(
        "id is not null and v is not null and size(v) > 0 and "
        "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and "
        "exists(v, x -> x <> 0)")
    sound = scratch.put("sound", sound.groupBy("id").agg(F.min("v").alias("v")))
    usual = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") \
        .withColumnRenamed("vec_id", id_col)
    if usual is None:
        return empty
    sound = sound.filter(F.size("v") == usual["n"])
    first = Window.partitionBy("v").orderBy("id")
    groups = sound.withColumn("place", F.row_number().over(first)).filter(
        F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = scratch.put("groups", groups.select(F.col("ids")[0].alias("pid"), "v", "ids"))
    facts = groups.agg(F.count("*"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    rate = min(1.0, 0.9 * FIT_ROWS / facts[0])
    sample = groups.filter(F.pmod(F.xxhash64("pid"), F.lit(1_000_000)) < rate * 1_000_000).select(
        "v").limit(FIT_ROWS).toPandas()["v"]
    if not len(sample):
        sample = groups.select("v").limit(FIT_ROWS).toPandas()["v"]
    curves = _fitted(np.stack(sample.to_list()).astype(float), float(facts[1]) ** 0.5, facts[0])
    points = scratch.put("points", groups.select("pid", "v").mapInArrow(
        _indexer(curves), f"pid long, v {kind}, blocks array<int>"))

    queries = scratch.put("queries", sound.filter(F.pmod("id", F.lit(every)) == 0).join(
        groups.select("pid", "v"), "v").select(F.col("id").alias("query_id"), "pid"))
    asked = points.join(queries.select("pid").distinct(), "pid", "left_semi")
    reach = _window_blocks(points, asked, k + 1)
    last = max(len(b) for b in curves.bounds)
    placed = F.posexplode("blocks").alias("ordering", "block")
    span = F.expr(f"sequence(greatest(block - {reach}, 0) div {PART_BLOCKS},"
                  f" least(block + {reach}, {last}) div {PART_BLOCKS})")
    asking = asked.select("pid", "v", placed).select(
        "ordering", F.expr(f"block div {PART_BLOCKS}").alias("part"), F.lit(0).alias("side"),
        "pid", "v")
    offered = points.select("pid", "v", placed).select(
        "ordering", F.explode(span).alias("part"), F.lit(1).alias("side"), "pid", "v")
    met = asking.union(offered).repartition("ordering", "part").sortWithinPartitions(
        "ordering", "part", "side").mapInArrow(_searcher(k + 1), "q long, c long, score double")
    best = scratch.put("best", _top(met.distinct(), k + 1).drop("place"))

    expanded = best.join(groups.select(F.col("pid").alias("c"), "ids"), "c").select(
        "q", F.explode("ids").alias("c"), "score")
    lists = _top(expanded, k + 1).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("place", "c", "score"))).alias("best"))
    each = queries.join(lists.withColumnRenamed("q", "pid"), "pid").select(
        "query_id", F.expr("filter(best, b -> b.c <> query_id)").alias("best"))
    return each.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.c").alias(id_col),
        F.col("b.score").alias("score"))
