"""Packing texts into padded batches whose length buckets are chosen for least padding.

A histogram of lengths over all texts is the only thing the driver sees. Dynamic programming
over it picks the bucket boundaries with the smallest total padding; the optimum split point
moves monotonously, so each layer is solved by divide and conquer. Inside a bucket every text
is padded to the boundary, and batches take as many texts as the token budget allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import Scratch
from tallyhouse.llm.wordstream import count_words, pieces


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least padding in all.

    `lengths` ascend and are distinct. Among equal optima, fewer buckets win.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = lengths.astype(np.float64)
    number = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0.0], np.cumsum(lengths * counts)])
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    splits: list[np.ndarray] = []
    totals = []
    for _ in range(min(buckets, n)):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        stack = [(1, n, 0, n - 1)]
        while stack:
            low, high, left, right = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(left, min(mid - 1, right) + 1)
            cost = best[i] + lengths[mid - 1] * (number[mid] - number[i]) - (
                tokens[mid] - tokens[i])
            at = int(cost.argmin())
            now[mid], split[mid] = cost[at], i[at]
            stack.append((low, mid - 1, left, int(i[at])))
            stack.append((mid + 1, high, int(i[at]), right))
        splits.append(split)
        totals.append(now[n])
        best = now
    used = int(np.argmin(totals)) + 1
    bounds, at = [], n
    for layer in range(used - 1, -1, -1):
        bounds.append(int(lengths[at - 1]))
        at = int(splits[layer][at])
        if at == 0:
            break
    return bounds[::-1]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), pa.array(count_words(piece.column("text")))],
                names=["doc", "n_tokens"])


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16,
    token_budget: int = 32_768, shard_rows: int = 100_000,
) -> DataFrame:
    """One row per row: id, n_tokens, bucket, padded_to, batch, n_in_batch, n_padding.

    A token is a word. `padded_to` is the bucket's boundary; a batch holds as many texts of
    one bucket as `token_budget` padded tokens allow, and at least one, so a text longer than
    the budget is a batch of its own and nothing is cut. Buckets are dealt by hashed id into
    shards of about `shard_rows` texts that are batched apart, so each shard leaves at most one
    batch unfilled; `batch` is `bucket-shard-number`.

    Empty and null texts have no tokens and need no place: bucket, padded_to, batch,
    n_in_batch are null, n_padding is 0. Null ids and repeated rows are texts like others.
    Boundaries are chosen over the exact lengths. Distinct ones add up to no more than all words,
    so there are at most about the root of twice the words: 100,000 in five thousand million.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    read = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    sized = scratch.put("sizes", read.mapInArrow(_counter, T.StructType(
        [read.schema["doc"], T.StructField("n_tokens", T.LongType())])))
    histogram = sized.filter("n_tokens > 0").groupBy(F.col("n_tokens").alias("length")).count() \
        .toPandas().sort_values("length")
    lengths, counts = histogram["length"].to_numpy(), histogram["count"].to_numpy()
    bounds = bucket_boundaries(lengths, counts, buckets)
    edges = np.searchsorted(bounds, lengths)
    members = np.bincount(edges, counts, minlength=len(bounds)) if len(bounds) else []
    layout = pd.DataFrame({
        "bucket": range(len(bounds)), "padded_to": bounds,
        "shards": [max(1, -(-int(m) // shard_rows)) for m in members],
        "capacity": [max(1, token_budget // b) for b in bounds]})
    tail = "padded_to long, batch string, n_in_batch long, n_padding long"
    if not bounds:
        return sized.select(F.col("doc").alias(id_col), "n_tokens", F.lit(None).cast("int").alias(
            "bucket"), *(F.lit(0 if c.startswith("n_p") else None).cast(t).alias(c)
                         for c, t in (x.split() for x in tail.split(", "))))
    bucket = F.when(F.col("n_tokens") > 0, F.aggregate(
        F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + (F.col("n_tokens") > b).cast("int")))

    def pick(column: str, kind: str):
        return F.get(F.array(*[F.lit(int(x)).cast(kind) for x in layout[column]]), F.col("bucket"))

    dealt = sized.withColumn("bucket", bucket).filter("bucket is not null").withColumn(
        "shard", F.pmod(F.xxhash64("doc", "n_tokens"), pick("shards", "long")))
    order = Window.partitionBy("bucket", "shard").orderBy("n_tokens", "doc")
    placed = dealt.withColumn(
        "number", F.floor((F.row_number().over(order) - 1) / pick("capacity", "long")))
    batch = Window.partitionBy("bucket", "shard", "number")
    full = placed.select(
        F.col("doc").alias(id_col), "n_tokens", "bucket",
        pick("padded_to", "long").alias("padded_to"),
        F.concat_ws("-", "bucket", "shard", "number").alias("batch"),
        F.count("*").over(batch).alias("n_in_batch"),
        (pick("padded_to", "long") - F.col("n_tokens")).alias("n_padding"))
    none = sized.filter("n_tokens = 0").select(
        F.col("doc").alias(id_col), "n_tokens", F.lit(None).cast("int").alias("bucket"),
        *(F.lit(0 if c.startswith("n_p") else None).cast(t).alias(c)
          for c, t in (x.split() for x in tail.split(", "))))
    return full.union(none)
