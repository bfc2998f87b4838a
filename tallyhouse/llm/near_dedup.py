"""Near-duplicate documents by SuperMinHash signatures, bands, exact checks and components.

Every shingle of a text deals its own permutation of the signature's slots; slot p keeps the
smallest rank + fraction dealt to it. Dealing goes rank by rank over all shingles of a text
and stops once every slot is filled, since later ranks cannot improve any (SuperMinHash's
early stop). Bands of slots name buckets.

Groups never become all their pairs:

* rows with equal shingle sets are one class, and only classes get into buckets;
* a class stays in a bucket only if its sketch is close to that of some other class there;
* each class is compared with the hub of its bucket (a star), and verified links form
  components;
* where a bucket then holds several components, the classes outside its largest one are
  compared with all of the bucket that are in other components. A missing link inside a
  component cannot change the result, so no component is lost to the shortcut.

Candidates must agree in enough single bits of their signatures, one of each slot, and are then
compared on their full sets, inside joins that give out links alone. With 40 bands of 6 slots, a
pair of similarity 0.8 shares no bucket with a chance of about 5 in a million; the bits turn it
away with one of 1 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch
from tallyhouse.llm.components import components
from tallyhouse.llm.wordstream import mix, pieces, shingle_sets, words_of

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_TURN = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
SPARSE_RANKS = 6
SKETCH_BITS = 256
SKETCH = ("s1", "s2", "s3", "s4")
SETS = "row long, class_id long, n int, members array<long>"
SIGNATURE = f"doc long, n int, k1 long, k2 long, {' long, '.join(SKETCH)} long, bands array<long>"


def superminhash(values: np.ndarray, text: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Signatures (texts x slots) of the sets given as member hashes and their text.

    A slot holds rank << 32 | fraction; a text without members keeps the filler in each. A
    member's permutation is kept as its few exchanges so far, later as a row of a matrix.
    """
    table = np.full(texts * slots, _EMPTY, np.uint64)
    base = text * slots
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    order = None
    for rank in range(slots):
        dealt = mix(values + np.uint64(_TURN * (rank + 1) & 0xFFFFFFFFFFFFFFFF))
        pick = (((dealt & _LOW) * np.uint64(slots - rank)) >> _HALF).astype(np.int64) + rank
        if rank < SPARSE_RANKS:
            slot, last = pick.copy(), np.full(len(pick), rank)
            for at, value in moves:
                np.copyto(slot, value, where=at == pick)
                np.copyto(last, value, where=at == rank)
            moves.append((pick, last))
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
                row = np.arange(len(values))
                for at, value in moves:
                    order[row, at] = value
            row = np.arange(len(values))
            slot = order[row, pick].astype(np.int64)
            order[row, pick] = order[:, rank]
        np.minimum.at(table, base + slot, np.uint64(rank << 32) | (dealt >> _HALF))
        going = (table.reshape(texts, slots) == _EMPTY).any(axis=1)[text]
        if not going.any():
            break
        if not going.all():
            values, text, base = values[going], text[going], base[going]
            if order is None:
                moves = [(at[going], value[going]) for at, value in moves]
            else:
                order = order[going]
    return table.reshape(texts, slots)


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums over the members of each set, which name it whatever their order; 0 of none."""
    filled = np.diff(bounds) > 0
    keys = [np.zeros(len(filled), np.uint64), np.zeros(len(filled), np.uint64)]
    for key, salt in zip(keys, (np.uint64(0x51ED270B), np.uint64(0xA24BAED4))):
        if len(values):
            key[filled] = np.add.reduceat(mix(values ^ salt), bounds[:-1][filled])
    return keys


def _signer(size: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                n_texts = piece.num_rows
                values, text, bounds = shingle_sets(words_of(piece.column("text"), True), size)
                count = np.diff(bounds)
                table = superminhash(values, text, n_texts, bands * rows).reshape(
                    n_texts, bands, rows)
                bits = np.zeros((n_texts, SKETCH_BITS), bool)
                spots = table.reshape(n_texts, -1)[:, :SKETCH_BITS]
                bits[:, : spots.shape[1]] = mix(spots) & np.uint64(1)
                sketch = np.packbits(bits, axis=1).view(np.int64)
                names = np.zeros((n_texts, bands), np.uint64)
                for r in range(rows):
                    names = mix(names + table[:, :, r])
                filled = count > 0
                keys = _set_keys(values, bounds)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(filled * bands)]), pa.int32()),
                    pa.array(names[filled].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(count, pa.int32()),
                     pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                     *(pa.array(np.ascontiguousarray(c)) for c in sketch.T), lists],
                    names=["doc", "n", "k1", "k2", *SKETCH, "bands"])
    return sign


def _set_lister(size: int):
    """Sets of the classes wanted. Texts of one id lie in one task, so a class is given once,
    or once for each piece where Spark splits a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for piece in pieces(batch, "text"):
                values, _, bounds = shingle_sets(words_of(piece.column("text"), True), size)
                right = np.ones(piece.num_rows, bool)  # an id may stand for other sets as well
                for key, name in zip(_set_keys(values, bounds), ("k1", "k2")):
                    right &= key.view(np.int64) == np.asarray(piece.column(name))
                for at, row in enumerate(piece.column("row").to_pylist()):
                    right[at] &= row not in given
                    if right[at]:
                        given.add(row)
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), piece.column("doc"), piece.column("n"), sets],
                    names=["row", "class_id", "n", "members"]).filter(pa.array(right))
    return run


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
    percent: int = 80, bands: int = 40, rows: int = 6,
) -> DataFrame:
    """One row per id: id, n_shingles, class_id, component_id, kept, n_links.

    Texts are lower-cased in A-Z and cut into words; a text's set holds its distinct runs of
    `words` words, or its whole sequence if it has fewer. Two sets are linked if 100 times
    their intersection is at least `percent` times their union. `class_id` is the smallest id
    with an equal set, `component_id` the smallest id reachable over links, `kept` tells
    whether the row is that one. `n_links` counts verified links of the class.

    Null, empty or blank texts have no set: they are linked with nothing and kept. Texts of any
    length count whole. Rows with a null id are linked with nothing and kept, each of them
    (component null). Rows that repeat an id are one document and give one row: all their sets
    belong to it, whatever links one of them links the document, and the row has the smallest
    set size and class among them. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = scratch.put("signatures", texts.mapInArrow(_signer(words, bands, rows), SIGNATURE).withColumn(
        "row", F.monotonically_increasing_id()))
    sets = signed.filter("n > 0 and doc is not null")
    # The stored row number of a class is its name until links are found.
    classes = scratch.put("classes", sets.groupBy("k1", "k2", "n").agg(
        F.min("doc").alias("class_id"), F.min("row").alias("row")))
    distinct = scratch.put("distinct", sets.select("row", "n", *SKETCH, "bands").join(
        classes.select("row", "class_id"), "row"))

    # Bits of unequal slots differ by a coin's toss; five deviations are allowed on top.
    odds = (1 - percent / 100) / 2
    drawn = min(SKETCH_BITS, bands * rows)
    most = int(drawn * odds + 5 * (drawn * odds * (1 - odds)) ** 0.5)

    def near(x: str, y: str):
        """Sets whose sizes or sketches differ more can't be similar enough."""
        return F.expr(
            f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) and "
            + " + ".join(f"bit_count({x}.{s} ^ {y}.{s})" for s in SKETCH) + f" <= {most}")

    def alike(x: str, y: str):
        """The full sets are similar enough."""
        return F.expr(f"size(array_intersect({x}.members, {y}.members)) * {100 + percent}L >= "
                      f"{percent}L * ({x}.n + {y}.n)")

    place = (F.col("x.band") == F.col("y.band")) & (F.col("x.name") == F.col("y.name"))
    buckets = distinct.select("row", F.posexplode("bands").alias("band", "name"))
    shared = scratch.put("shared", buckets.groupBy("band", "name").agg(
        F.count("*").alias("size")).filter("size > 1").drop("size"))
    filled = scratch.put("filled", buckets.join(shared, ["band", "name"]).join(
        distinct.drop("bands"), "row"))
    other = F.col("x.row") != F.col("y.row")
    alive = scratch.put("alive", filled.alias("x").join(
        filled.select("row", "band", "name", "n", *SKETCH).alias("y"),
        place & other & near("x", "y"), "left_semi"))
    scratch.drop("shared", "filled")

    # The only time that texts move: those of classes with a partner become sets.
    wanted = classes.join(alive.select("row").distinct(), "row").select(
        F.col("class_id").alias("doc"), "k1", "k2", "n", "row")
    members = scratch.put("sets", texts.join(wanted, "doc").mapInArrow(_set_lister(words), SETS))

    hubs = scratch.put("hubs", alive.groupBy("band", "name").agg(
        F.min(F.struct("row", "n", *SKETCH)).alias("y")))
    star = alive.alias("x").join(hubs, ["band", "name"]).filter(
        F.col("row") != F.col("y.row")).filter(near("x", "y")).select(
        F.col("x.row").alias("from"), F.col("y.row").alias("to")).distinct()
    x, y = members.alias("x"), members.alias("y")
    found = scratch.put("links-0", star.join(x, F.col("from") == F.col("x.row")).join(
        y, (F.col("to") == F.col("y.row")) & alike("x", "y")).select(
        F.greatest("x.class_id", "y.class_id").alias("a"), F.least("x.class_id", "y.class_id").alias("b")))

    reached = components(found, scratch, "first").select(F.col("node").alias("class_id"), "component")
    placed = scratch.put("placed", alive.join(reached, "class_id", "left").withColumn(
        "component", F.coalesce("component", "class_id")))
    several = scratch.put("several", placed.groupBy("band", "name", "component").agg(
        F.count("*").alias("size")).groupBy("band", "name").agg(
        F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("most")).filter(
        "parts > 1").select("band", "name", F.col("most.component").alias("largest")))
    torn = scratch.put("torn", placed.join(several, ["band", "name"]).join(
        distinct.select("row", "bands"), "row"))
    minor = torn.filter("component <> largest")
    scratch.drop("alive", "hubs", "placed", "several")

    # Two classes are compared in the first bucket they share; rows without a partner left go
    # before sets come in.
    x, y = minor.alias("x"), torn.alias("y")
    first = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) = x.band + 1")
    likely = place & (F.col("x.component") != F.col("y.component")) & near("x", "y") & first
    left = scratch.put("left", x.join(y, likely, "left_semi"))
    right = scratch.put("right", y.join(left.alias("x"), likely, "left_semi"))
    full = members.select("row", "members")
    x, y = left.join(full, "row").alias("x"), right.join(full, "row").alias("y")
    last = scratch.put("links-1", x.join(y, likely & alike("x", "y")).select(
        F.greatest("x.class_id", "y.class_id").alias("a"),
        F.least("x.class_id", "y.class_id").alias("b")).distinct())
    scratch.drop("torn", "left", "right", "sets", "distinct")

    # Sets of rows that repeat an id belong together.
    several = sets.groupBy("doc").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter(
        "low < high").select("doc")
    own = sets.join(several, "doc").join(classes, ["k1", "k2", "n"]).select("doc", "class_id").distinct()
    tied = own.join(own.groupBy("doc").agg(F.min("class_id").alias("least")), "doc").filter(
        "class_id > least").select(F.col("class_id").alias("a"), F.col("least").alias("b"))
    links = scratch.put("links", found.unionByName(last).filter("a <> b").distinct())
    final = components(links.unionByName(tied), scratch, "last")

    degree = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy(
        "class_id").agg(F.count("*").alias("n_links"))
    by_class = classes.drop("row").join(degree, "class_id", "left").join(
        final.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = signed.select("doc", "n", "k1", "k2").join(by_class, ["k1", "k2", "n"], "left").select(
        "doc", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("class_id", "doc").alias("class_id"),
        F.coalesce("component", "class_id", "doc").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
    one = known.filter("doc is not null").groupBy("doc").agg(
        F.min("n_shingles").alias("n_shingles"), F.min("class_id").alias("class_id"),
        F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    nameless = signed.filter("doc is null").selectExpr(
        "doc", "cast(n as long) as n_shingles", "doc as class_id", "doc as component_id",
        "0L as n_links")
    return one.union(nameless).select(
        F.col("doc").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"),
        "class_id", "n_links")
