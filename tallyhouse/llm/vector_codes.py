"""Product-quantised codes of integer vectors, with exact distances from float products.

Components become integers; a vector is cut into equal parts and each part is replaced by the
number of its nearest codebook entry. Distances compare as |c|^2 - 2 a.c, so a block of parts
needs one matrix product. Floats do that product exactly: integers are split into limbs so
narrow that a sum of limb products stays below 2^53, the limb products go through BLAS, and
int64 shifts put the dot products together again.

Codebooks are small (parts x entries x width integers, whatever the number of rows), so every
task gets them whole and gives back one sum and one count per entry; Spark adds those up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch

SCALE = 1024
BLOCK_ROWS = 2048
EXACT_BITS = 53
LONG_BITS = 63
FAR = "9.2e18"


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of integers, low ones first: values = sum of limb i * 2^(bits * i).

    All limbs but the last lie in [0, 2^bits); the last carries the sign, from -2^bits on.
    """
    out, rest = [], values
    while True:
        high = rest >> bits
        if ((high == 0) | (high == -1)).all():
            return [*out, rest.astype(np.float64)]
        out.append((rest - (high << bits)).astype(np.float64))
        rest = high


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact wherever the result fits int64."""
    width = max(1, a.shape[1])
    # A limb reaches 2^bits, so width products of two stay within 2^53.
    bits = (EXACT_BITS - width.bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            if bits * (i + j) <= LONG_BITS:
                out += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def _wide(values: np.ndarray) -> bool:
    """Whether squared distances of such parts could leave int64."""
    if not values.size:
        return False
    most = max(int(values.max()), -int(values.min()))
    return values.shape[-1] * (2 * most) ** 2 >= 1 << LONG_BITS


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, squared distance) of every part; ties to the lower number.

    Integers too large for int64 distances are taken as Python integers.
    """
    at = np.empty(len(parts), np.int64)
    if _wide(parts) or _wide(book):
        far = np.empty(len(parts), object)
        mine, entries = parts.astype(object), book.astype(object)
        for row, x in enumerate(mine):
            d = ((entries - x) ** 2).sum(axis=1)
            at[row] = np.argmin(d)
            far[row] = d[at[row]]
        return at, far
    far = np.empty(len(parts), np.int64)
    norms = (book * book).sum(axis=1)
    for low in range(0, len(parts), BLOCK_ROWS):
        block = parts[low: low + BLOCK_ROWS]
        d = norms - 2 * exact_products(block, book)
        best = np.argmin(d, axis=1)  # the first of equals
        at[low: low + len(block)] = best
        far[low: low + len(block)] = d[np.arange(len(block)), best] + (block * block).sum(axis=1)
    return at, far


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _cells(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """Integers as (parts, rows, width)."""
    x = _matrix(batch.column("cells"))
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def _summer(books: np.ndarray):
    """Per task: part, entry, number of its rows and their sum by place; unused entries give none."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros(books.shape, object if _wide(books) else np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, block in enumerate(_cells(batch, parts)):
                at, _ = assign(block, books[p])
                count[p] += np.bincount(at, minlength=entries)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                if len(used):
                    if _wide(block) and total.dtype != object:
                        total = total.astype(object)
                    rows = block[order].astype(total.dtype)
                    total[p, used] += np.add.reduceat(rows, first, axis=0)
        p, k = np.nonzero(count)
        flat = total[p, k].ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(p, width), pa.int32()), pa.array(np.repeat(k, width), pa.int32()),
             pa.array(np.tile(np.arange(width), len(p)), pa.int32()),
             pa.array(np.repeat(count[p, k], width), pa.int64()),
             pa.array([str(v) for v in flat])],
            names=["part", "entry", "place", "n", "total"])
    return run


def _coder(books: np.ndarray):
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names, error = [], 0
            for p, block in enumerate(_cells(batch, parts)):
                at, far = assign(block, books[p])
                names.append(at)
                error = error + far
            if error.dtype == object:
                error = [v if v < 1 << LONG_BITS else None for v in error]
            codes = ["".join(f"{k:02x}" for k in row) for row in np.stack(names, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("label"), pa.array(codes, pa.string()),
                 pa.array(error, pa.int64())], names=["vec", "label", "code", "error"])
    return run


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, np.ndarray]:
    """(coded rows, codebooks): rows of id, code, error, label_error; books (parts, entries, width).

    A component x counts as floor(1024 x). The codebook of a part position starts as that part
    of the `entries` smallest ids; each round assigns every part to its nearest entry and moves
    the entry to the floor of its parts' mean, entries without parts stay. Parts are then
    assigned once more: `code` has two hex digits a part, `error` is the squared distance
    summed over parts, `label_error` that summed over all rows of the label.

    Rows whose vector is null, empty or holds a null or non-finite component take no part.
    Neither do vectors of another length than that of the smallest id left, or of a length that
    `parts` does not divide. Null ids come after all others; rows of one id are ordered by their
    vectors, and repeated rows count each. Fewer rows than `entries` make smaller codebooks, no
    rows give none. Null labels form one group. Integers beyond 9.2e18
    on either side are set to that; integers too large for int64 distances are compared as Python integers, and an error
    beyond a long, or a label's sum with one, is null. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    whole = vectors.select(
        F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"),
        F.expr(f"transform({vector_col}, x -> cast(x as double))").alias("x")).filter(
        "size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    cells = scratch.put("cells", whole.select("vec", "label", F.expr(
        f"transform(x, c -> floor(greatest(least(c * {SCALE}d, {FAR}d), -{FAR}d)))").alias("cells")).filter(
        f"size(cells) % {parts} = 0"))
    order = (F.col("vec").asc_nulls_last(), F.col("cells"))
    first = cells.orderBy(*order).limit(1).collect()
    if not first:
        empty = cells.select(F.col("vec").alias(id_col), F.lit("").alias("code"),
                             F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    length = len(first[0]["cells"])
    cells = cells.filter(F.size("cells") == length)
    seeds = cells.orderBy(*order).limit(entries).collect()
    books = np.array([r["cells"] for r in seeds], np.int64).reshape(
        len(seeds), parts, length // parts).transpose(1, 0, 2).copy()

    for _ in range(rounds):
        sums = cells.mapInArrow(
            _summer(books), "part int, entry int, place int, n long, total string").groupBy(
            "part", "entry", "place").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        for r in sums:  # one row for each number in the codebooks
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]

    kind = cells.schema["label"].dataType.simpleString()
    coded = scratch.put("codes", cells.mapInArrow(
        _coder(books), f"vec long, label {kind}, code string, error long"))
    scratch.drop("cells")
    by_label = coded.groupBy("label").agg(
        F.expr("if(count(error) = count(*), try_sum(error), null)").alias("label_error")).withColumnRenamed(
        "label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec").alias(id_col), "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks in order, as decimals with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
