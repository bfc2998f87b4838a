"""What each filter removes, in every order, from 32 states of a Gray-code walk.

A document's mask has one bit for each filter it fails. Per part, documents are counted by
mask; nothing after that depends on how many there are. The walk visits all subsets of
filters so that neighbours differ in one filter: toggling it raises or lowers the number of
active failures of the cells with its bit, and only cells whose number leaves or reaches zero
change the running survivors. The survivors of each subset are stored; a step of any order is
the difference of two stored states.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MEASURES = ("docs", "good", "toxic")
SPACES = r"[\x20\x09-\x0D]+"
AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
         "unique_fails long, good_lost long, toxic_lost long, shapley long")


def failures(text):
    """Mask of the filters A to D that a text fails; null counts as empty."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        F.when(F.size(words) < 100, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 2).otherwise(0)
        + F.when(100 * capitals.cast("long") > 10 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0))


def walk(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: cells (..., masks) to states of the same shape.

    cells[..., m] counts what fails exactly the filters of mask m; states[..., s] what no
    filter of subset s removes.
    """
    masks = np.arange(cells.shape[-1])
    active = np.zeros(len(masks), int)
    running = cells.sum(axis=-1)
    states = np.empty_like(cells)
    states[..., 0] = running
    subset = 0
    for turn in range(1, len(masks)):
        bit = turn & -turn  # the bit in which this Gray code differs from the last
        subset ^= bit
        hit = masks & bit > 0
        if subset & bit:
            gone = hit & (active == 0)
            active[hit] += 1
            running = running - cells[..., gone].sum(axis=-1)
        else:
            active[hit] -= 1
            back = hit & (active == 0)
            running = running + cells[..., back].sum(axis=-1)
        states[..., subset] = running
    return states


def _orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, subset applied before it) of every step of every order."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _orders()
    names, steps, bits, before = (np.array(c) for c in zip(*orders))
    subsets = np.arange(1 << len(FILTERS))
    size = np.array([bin(s).count("1") for s in subsets])
    weight = np.array([factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # 600 rows a part
            some = batch.slice(at, 256)
            cells = np.stack([np.asarray(some.column(m).flatten()).reshape(-1, len(subsets))
                              for m in MEASURES])
            states = walk(cells)
            lost = states[:, :, before] - states[:, :, before | bits]
            failing = states[0][:, [0]] - states[0][:, bits]
            shares = {}
            for bit in (1 << i for i in range(len(FILTERS))):
                without = subsets[subsets & bit == 0]
                shares[bit] = ((states[0][:, without] - states[0][:, without | bit])
                               * weight[size[without]]).sum(axis=1)
            shapley = np.stack([shares[b] for b in bits], axis=1)
            n = some.num_rows
            yield pa.RecordBatch.from_arrays(
                [some.column("part").take(pa.array(np.repeat(np.arange(n), len(orders)))),
                 pa.array(np.tile(names, n)), pa.array(np.tile(steps, n), pa.int32()),
                 *(pa.array(np.ascontiguousarray(x).ravel(), pa.int64()) for x in (
                     states[0][:, before | bits], lost[0], failing - lost[0], cells[0][:, bits],
                     lost[1], lost[2], shapley))],
                names=[c.split()[0] for c in AUDIT.split(", ")])


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row per part, order of the five filters and step: what the step removes.

    Filters: A fewer than 100 words; B distinct words under 80 % of words; C more than 10 %
    of code points in A-Z; D one of ``#$%&*|``; E a text that a smaller id holds too. Columns:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley; all counts are of documents of the part.

    A null text is an empty one, a null part the empty string. Texts of any length are judged
    whole. Rows that repeat an id count one by one; copies of a text within one id do not
    fail E. A null id is neither smaller nor larger than another: its row never fails E and no
    row fails E for its sake. An id with several label rows is good (toxic) if one of them
    says so; labels of null ids are left out. Without documents there are no rows. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(text_col, F.lit(""))
    marked = docs.select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(part_col, F.lit("")).alias("part"),
        failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = scratch.put("rows", marked.join(known, "doc", "left").fillna(0, ["good", "toxic"]))

    # Every row fails E but those of a text's smallest id. These are few a text, however many
    # copies it has, and the pair (text, id) finds them without gathering the copies.
    least = rows.filter("doc is not null").groupBy("digest").agg(F.min("doc").alias("doc"))
    first = rows.join(least, ["digest", "doc"], "left_semi").unionByName(rows.filter("doc is null"))

    def counted(frame: DataFrame, mask, sign: int) -> DataFrame:
        return frame.groupBy("part", mask.alias("mask")).agg(
            (sign * F.count("*")).alias("docs"), (sign * F.sum("good")).alias("good"),
            (sign * F.sum("toxic")).alias("toxic"))

    failing = F.col("mask") + COPY
    cells = counted(rows, failing, 1).unionByName(counted(first, failing, -1)).unionByName(
        counted(first, F.col("mask"), 1)).groupBy("part", "mask").agg(
        *(F.sum(m).alias(m) for m in MEASURES))
    by_mask = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(
        F.struct("mask", F.struct(*MEASURES)))).alias("cells"))
    last = (1 << len(FILTERS)) - 1
    return by_mask.select("part", *(F.expr(
        f"transform(sequence(0, {last}), i -> coalesce(try_element_at(cells, i).{m}, 0L)) AS {m}")
        for m in MEASURES)).mapInArrow(
        _audit, AUDIT)
