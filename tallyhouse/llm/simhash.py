"""SimHash near duplicates by the generalised pigeonhole principle.

A fingerprint bit is the majority of that bit over the hashes of all shingles of a text.
Fingerprints that differ in few bits are found through parts of their bits:

1. Bits are grouped into blocks of correlated ones, from their counts over all fingerprints.
   The values of each block are counted as well, which tells how many fingerprints lie within
   0, 1, 2 ... bits of any value of it.
2. Parts are runs of blocks. Fingerprints at `most` bits or fewer differ in less than u bits
   of some part whenever the u of all parts add up to most + 1. For every fingerprint a
   dynamic programme deals these units so that estimated candidates and lookups cost least;
   a part with a common value gets none, and others more. The number of parts is the one
   with the smallest sum of such costs over all fingerprints.
3. Each fingerprint lies in one bucket a part and looks into the buckets within its threshold.
   Buckets are cut into tiles of bounded size; a tile compares whole fingerprints and gives
   back a spanning forest of what it links, never its pairs.

Equal fingerprints are one class before all this, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch
from tallyhouse.llm.components import components
from tallyhouse.llm.wordstream import pieces, words_of

SEED = 42
BITS = 64
BLOCK_BITS = 8
BLOCKS = BITS // BLOCK_BITS
LAYOUTS = (2, 3, 4, 8)  # parts
LOOKUP_COST = 40.0  # of a row that looks into a bucket, in comparisons
TILE = 8192
PAIRS = 1 << 20
CHUNK = 1 << 14


# --- fingerprints -------------------------------------------------------------------


def majority(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Fingerprint of each text from the hashes of its shingles; of none, zero."""
    ones = np.zeros((texts, BITS), np.int64)
    for low in range(0, len(hashes), CHUNK):
        part, owner = hashes[low: low + CHUNK], text[low: low + CHUNK]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        np.add.at(ones, owner[first], np.add.reduceat(bits, first, axis=0, dtype=np.int64))
    total = np.bincount(text, minlength=texts)
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of `size` words joined by spaces, its text)."""
    words = words_of(texts, fold=True)
    data = words.data.tobytes()
    start, end, digest = words.start.tolist(), words.end.tolist(), xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for t, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
        if a == b:
            continue
        own = [data[s:e] for s, e in zip(start[a:b], end[a:b])]
        count[t] = max(1, len(own) - size + 1)
        runs = zip(*(own[i:] for i in range(size))) if len(own) >= size else [own]
        hashes.extend([digest(b" ".join(run), SEED) for run in runs])
    return np.array(hashes, np.uint64), np.repeat(np.arange(len(texts)), count)


def _fingerprinter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, text = _shingle_hashes(piece.column("text"), size)
                prints = majority(hashes, text, piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(prints.view(np.int64))], names=["doc", "print"])
    return run


# --- bits, blocks and costs ---------------------------------------------------------


def _unpacked(prints: np.ndarray) -> np.ndarray:
    """(n, 64) bits, the lowest first."""
    return np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("print")).view(np.uint64)


def _bit_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are set together (place 64 i + j)."""
    both = np.zeros((BITS, BITS))
    for batch in batches:
        bits = _unpacked(_prints(batch)).astype(np.float64)
        both += bits.T @ bits
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BITS * BITS)), pa.array(both.ravel().astype(np.int64))], names=["at", "n"])


def correlated_blocks(both: np.ndarray, rows: int) -> np.ndarray:
    """Bits in the order of their blocks: every block starts from the two most correlated bits
    left and takes in the bit that is most correlated with those it has."""
    share = np.diag(both) / max(rows, 1)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    tie = np.abs(np.divide(both / max(rows, 1) - np.outer(share, share), scale,
                           out=np.zeros_like(scale), where=scale > 0))
    np.fill_diagonal(tie, 0)
    left, order = list(range(BITS)), []
    while left:
        own = tie[np.ix_(left, left)]
        a = left[int(np.argmax(own.max(axis=1)))]
        block = [a]
        left.remove(a)
        while len(block) < BLOCK_BITS:
            b = left[int(np.argmax(tie[np.ix_(block, left)].sum(axis=0)))]
            block.append(b)
            left.remove(b)
        order += block
    return np.array(order)


def _blocks_of(prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(n, blocks) values of the blocks."""
    return np.packbits(_unpacked(prints)[:, order], axis=1, bitorder="little")


def _block_counter(order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BLOCKS, 1 << BLOCK_BITS), np.int64)
        for batch in batches:
            blocks = _blocks_of(_prints(batch), order)
            for b in range(BLOCKS):
                counts[b] += np.bincount(blocks[:, b], minlength=1 << BLOCK_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(counts.size)), pa.array(counts.ravel())], names=["at", "n"])
    return run


def shares_by_distance(counts: np.ndarray, most: int) -> np.ndarray:
    """(blocks, values, most + 1): share of the fingerprints at exactly k bits from a value."""
    values = np.arange(1 << BLOCK_BITS)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    total = np.maximum(counts.sum(axis=1), 1)
    return np.stack([(counts @ (apart == k)) / total[:, None] for k in range(most + 1)], axis=-1)


def runs_of_blocks(parts: int) -> list[range]:
    """Blocks of each part, as even as can be."""
    edges = [round(i * BLOCKS / parts) for i in range(parts + 1)]
    return [range(a, b) for a, b in zip(edges[:-1], edges[1:])]


def flips(width: int, below: int) -> np.ndarray:
    """All values of `width` bits with fewer than `below` set, the fewest first."""
    return np.array([sum(1 << i for i in some) for k in range(below)
                     for some in combinations(range(width), k)], np.int64)


def deal_units(blocks: np.ndarray, shares: np.ndarray, rows: int, parts: int, most: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(units of each fingerprint and part, cost of each fingerprint), by dynamic programming.

    u units let a fingerprint look into all buckets of a part at less than u bits. Its cost is
    that of the lookups and of the candidates expected in them, were blocks independent.
    """
    n, units = len(blocks), most + 1
    price = np.zeros((parts, n, units + 1))
    for p, run in enumerate(runs_of_blocks(parts)):
        near = np.zeros((n, units))
        near[:, 0] = 1
        for b in run:
            own = shares[b][blocks[:, b]]
            near = np.stack([sum(near[:, j] * own[:, k - j] for j in range(k + 1))
                             for k in range(units)], axis=1)
        for u in range(1, units + 1):
            looks = len(flips(BLOCK_BITS * len(run), u))
            price[p, :, u] = LOOKUP_COST * looks + rows * near[:, :u].sum(axis=1)
    best = np.full((parts + 1, n, units + 1), np.inf)
    best[0, :, 0] = 0
    taken = np.zeros((parts, n, units + 1), np.int64)
    for p in range(parts):
        for total in range(units + 1):
            options = np.stack([best[p, :, total - u] + price[p, :, u] for u in range(total + 1)], axis=1)
            taken[p, :, total] = np.argmin(options, axis=1)
            best[p + 1, :, total] = options.min(axis=1)
    chosen = np.zeros((n, parts), np.int64)
    left = np.full(n, units)
    for p in range(parts - 1, -1, -1):
        chosen[:, p] = taken[p, np.arange(n), left]
        left -= chosen[:, p]
    return chosen, best[parts, :, units] + LOOKUP_COST * parts


def _coster(order: np.ndarray, shares: np.ndarray, rows: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(len(LAYOUTS))
        for batch in batches:
            blocks = _blocks_of(_prints(batch), order)
            cost += [deal_units(blocks, shares, rows, parts, most)[1].sum() for parts in LAYOUTS]
        yield pa.RecordBatch.from_arrays([pa.array(LAYOUTS), pa.array(cost)], names=["parts", "cost"])
    return run


# --- lookups and tiles --------------------------------------------------------------


def _looker(order: np.ndarray, shares: np.ndarray, rows: int, parts: int, most: int):
    """Rows of buckets: a fingerprint is found in one bucket a part and asks in those it looks into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # hundreds of lookups a row
                some = batch.slice(at, 1024)
                blocks = _blocks_of(_prints(some), order)
                units, _ = deal_units(blocks, shares, rows, parts, most)
                for p, run_ in enumerate(runs_of_blocks(parts)):
                    value = np.zeros(len(blocks), np.int64)
                    for shift, b in enumerate(run_):
                        value |= blocks[:, b].astype(np.int64) << (BLOCK_BITS * shift)
                    rows_, values, asks, found = [], [], [], []
                    for u in range(most + 2):
                        own = np.flatnonzero(units[:, p] == u)
                        around = flips(BLOCK_BITS * len(run_), max(u, 1))
                        rows_.append(np.repeat(own, len(around)))
                        values.append((value[own][:, None] ^ around[None, :]).ravel())
                        asks.append(np.full(len(own) * len(around), u > 0))
                        found.append(np.tile(around == 0, len(own)))
                    rows_ = np.concatenate(rows_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows_), p), pa.int32()), pa.array(np.concatenate(values)),
                         some.column("print").take(pa.array(rows_)), some.column("node").take(pa.array(rows_)),
                         pa.array(np.concatenate(asks)), pa.array(np.concatenate(found))],
                        names=["part", "value", "print", "node", "asks", "found"])
    return run


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index reached) after adding links a-b to the forest `label`."""
    while True:
        x, y = label[a], label[b]
        torn = x != y
        if not torn.any():
            return label
        a, b, x, y = a[torn], b[torn], x[torn], y[torn]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def link_groups(group: np.ndarray, prints: np.ndarray, asks: np.ndarray, found: np.ndarray, most: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between asking and found rows of the same group (groups lie together)."""
    label = np.arange(len(group))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    askers, targets = np.flatnonzero(asks), np.flatnonzero(found)
    own = np.searchsorted(first, askers, "right") - 1
    low = np.searchsorted(targets, first[own])
    high = np.searchsorted(targets, np.append(first, len(group))[own + 1])
    width = high - low
    done = np.cumsum(width)
    at = 0
    while at < len(askers):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        n = width[at:upto]
        x = np.repeat(askers[at:upto], n)
        y = targets[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:upto], n)]
        near = np.flatnonzero(np.bitwise_count(prints[x] ^ prints[y]) <= most)
        label = spanning(label, x[near], y[near])
        at = upto
    tree = np.flatnonzero(label != np.arange(len(label)))
    return tree, label[tree]


def _tile_linker(most: int):
    keys = ("part", "value", "i", "j")

    def forest(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [np.asarray(batch.column(k)) for k in keys]
        fresh = np.zeros(batch.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        a, b = link_groups(np.cumsum(fresh), _prints(batch), np.asarray(batch.column("asks")),
                           np.asarray(batch.column("found")), most)
        node = np.asarray(batch.column("node"))
        links = np.stack([node[a], node[b]], axis=1)
        links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            held = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            last = np.ones(held.num_rows, bool)  # rows of the tile that may go on in the next batch
            for k in keys:
                c = np.asarray(held.column(k))
                last &= c == c[-1]
            cut = int(np.argmax(last))
            if cut:
                yield forest(held.slice(0, cut))
                kept = [held.slice(cut)]
        if kept:
            yield forest(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
    return run


def _sums(frame: DataFrame, size: int) -> np.ndarray:
    """Counts by place, added up over tasks; `size` rows come to the driver."""
    out = np.zeros(size, np.int64)
    for r in frame.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _tiles(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Every row with the tiles (i, j) it takes part in: askers of chunk i, found rows of chunk j."""
    own = F.xxhash64("print")
    dealt = rows.join(hot, ["part", "value"], "left").select(
        "part", "value", "print", "node", "asks", "found",
        F.coalesce("askers", F.lit(1)).alias("across"), F.coalesce("targets", F.lit(1)).alias("down"),
        own.alias("own"))
    as_asker = dealt.filter("asks and not (across = 1 and down = 1)").select(
        "part", "value", F.expr("pmod(own, across)").alias("i"),
        F.explode(F.expr("sequence(0L, down - 1L)")).alias("j"), "print", "node",
        F.lit(True).alias("asks"), F.lit(False).alias("found"))
    as_target = dealt.filter("found and not (across = 1 and down = 1)").select(
        "part", "value", F.explode(F.expr("sequence(0L, across - 1L)")).alias("i"),
        F.expr("pmod(own, down)").alias("j"), "print", "node",
        F.lit(False).alias("asks"), F.lit(True).alias("found"))
    usual = dealt.filter("across = 1 and down = 1").select(
        "part", "value", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"),
        "print", "node", "asks", "found")
    return usual.unionByName(as_asker).unionByName(as_target)


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3,
    tile: int = TILE,
) -> DataFrame:
    """One row per id and fingerprint: id, fingerprint (hex), class_id, component_id.

    Texts are lower-cased in A-Z and cut into words; every run of `words` words counts, as often
    as it stands there (a shorter text counts as one run). A fingerprint bit is set if more
    than half of the runs' XXH64 values have it. Fingerprints at `most` bits or fewer are
    linked; `class_id` is the smallest id with the same fingerprint, `component_id` the
    smallest id reachable.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts of
    any length count whole. Rows that repeat an id are one document: each different
    fingerprint of it gives one row, and all of them have one component. Rows with a null id
    are returned one by one, linked with nothing (class and component null). An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.put("prints", docs.select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        _fingerprinter(words), "doc long, print long"))
    classes = scratch.put("classes", prints.filter("doc is not null").groupBy("print").agg(
        F.min("doc").alias("node")))
    n = classes.count()

    both = _sums(classes.select("print").mapInArrow(_bit_counter, "at long, n long"), BITS * BITS)
    order = correlated_blocks(both.reshape(BITS, BITS).astype(float), n)
    counts = _sums(classes.select("print").mapInArrow(_block_counter(order), "at long, n long"),
                   BLOCKS << BLOCK_BITS).reshape(BLOCKS, -1)
    shares = shares_by_distance(counts, most)
    costs = {r["parts"]: r["cost"] for r in classes.select("print").mapInArrow(
        _coster(order, shares, n, most), "parts long, cost double").groupBy("parts").agg(
        F.sum("cost").alias("cost")).collect()}
    parts = min(costs, key=lambda p: (costs[p], p)) if costs else LAYOUTS[0]

    rows = scratch.put("lookups", classes.mapInArrow(
        _looker(order, shares, n, parts, most),
        "part int, value long, print long, node long, asks boolean, found boolean"))
    hot = scratch.put("hot", rows.groupBy("part", "value").agg(
        F.ceil(F.count_if("asks") / tile).alias("askers"),
        F.ceil(F.count_if("found") / tile).alias("targets")).filter("askers > 1 or targets > 1"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(costs.get(parts, 0) / 2e8))
    tiles = _tiles(rows, hot).repartition(tasks, "part", "value", "i", "j").sortWithinPartitions(
        "part", "value", "i", "j")
    links = scratch.put("links", tiles.mapInArrow(_tile_linker(most), "a long, b long").distinct())
    scratch.drop("lookups", "hot")

    # Ids that stand for several fingerprints tie those together.
    several = prints.filter("doc is not null").groupBy("doc").agg(
        F.min("print").alias("low"), F.max("print").alias("high")).filter("low < high").select("doc")
    known = prints.join(several, "doc").join(classes, "print").select("doc", "node").distinct()
    same = known.join(known.groupBy("doc").agg(F.min("node").alias("least")), "doc").filter(
        "node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    reached = components(links.unionByName(same), scratch, "reached")
    scratch.drop("links")

    placed = classes.join(reached, "node", "left").select(
        "print", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"))
    named = prints.filter("doc is not null").distinct().join(placed, "print")
    nameless = prints.filter("doc is null").select(
        "print", "doc", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless).select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "class_id", "component_id")
