"""Language of a text by n-gram filters whose cells hold a bit for every language.

Each language has a Bloom filter over its usual byte n-grams; the filters are stored bit-sliced,
so that one cell holds the same position of all of them as a mask. The masks of an n-gram's
cells are combined by AND and give every language that knows the n-gram at once. A text's hits
are counted per language, the hits that a language's filter gives by chance are taken off, and
the language with most of what is left is the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.wordstream import mix, pieces, text_buffers
from tallyhouse.session import ship

SIZES = (3, 4)
# An n-gram is its size and its bytes in one number.
_GRAM_BITS, _GRAM_MASK = np.uint64(36), np.uint64((1 << 36) - 1)
PROBES = 3
CELLS = 1 << 20
PIECE_BYTES = 1 << 18
UNKNOWN = "und"
# Bytes of letters keep their value, others become a space; bytes above ASCII belong to letters.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x61, 0x7B), *range(0x80, 0x100)]


class Filters(NamedTuple):
    """Languages, cells (probes share them) and each language's chance hit rate."""

    languages: list[str]
    cells: np.ndarray
    chance: np.ndarray


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: n-grams that hold a letter, as numbers, and the text of each."""
    raw, offsets = text_buffers(pc.utf8_lower(texts))
    data = _FOLD[raw].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    blank = data == 0x20
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        value = np.full(n, size, np.uint64)
        for i in range(size):
            value = (value << np.uint64(8)) | data[i: i + n]
        use = (owner[:n] == owner[size - 1:]) & ~(blank[:n] & blank[1: n + 1])
        yield value[use], owner[:n][use]


def _places(grams: np.ndarray, cells: int) -> list[np.ndarray]:
    name = mix(grams)
    first, step = name & np.uint64(0xFFFFFFFF), (name >> np.uint64(32)) | np.uint64(1)
    return [((first + step * np.uint64(i)) & np.uint64(cells - 1)).astype(np.int64)
            for i in range(PROBES)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each language that hold an n-gram, summed inside a piece."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            at = np.asarray(piece.column("at"))
            held = []
            for grams, owner in _grams(piece.column("text")):
                once = np.unique((owner.astype(np.uint64) << _GRAM_BITS) | grams)
                of = at[(once >> _GRAM_BITS).astype(np.int64)].astype(np.uint64)
                held.append((of << _GRAM_BITS) | (once & _GRAM_MASK))
            if not held:
                continue
            pairs, count = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((pairs >> _GRAM_BITS).astype(np.int32)),
                 pa.array((pairs & _GRAM_MASK).view(np.int64)),
                 pa.array(count, pa.int64())], names=["at", "gram", "n"])


def fit_filters(labelled: DataFrame, sample: int = 1000, share: float = 0.02,
                cells: int = CELLS) -> Filters:
    """Filters of every value of `lang` in (key, text, lang).

    About `sample` texts of each language are read, those whose hashed key comes first; an
    n-gram enters a language's filter if at least `share` of them hold it, which bounds a
    filter to the n-grams of 1 / share texts of average length.
    """
    ship(labelled.sparkSession)
    labelled = labelled.filter("lang is not null and text is not null")
    counts = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    languages = [lang for lang, _ in counts]
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((cells, max(1, -(-len(languages) // 64))), kind)
    if not languages:
        return Filters([], table, np.zeros(0))
    rates = {lang: (i, min(1.0, 1.2 * sample / n)) for i, (lang, n) in enumerate(counts)}
    index = F.create_map(*[F.lit(x) for lang, (i, _) in rates.items() for x in (lang, i)])
    rate = F.create_map(*[F.lit(x) for lang, (_, r) in rates.items() for x in (lang, r)])
    drawn = labelled.filter(
        F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000).select(
        index[F.col("lang")].alias("at"), "text")
    sizes = {i: min(n, 1.2 * sample) for i, (_, n) in enumerate(counts)}
    need = F.create_map(*[F.lit(x) for i, n in sizes.items() for x in (i, max(2.0, share * n))])
    usual = drawn.mapInArrow(_counter, "at int, gram long, n long").groupBy("at", "gram").agg(
        F.sum("n").alias("n")).filter(F.col("n") >= need[F.col("at")]).select(
        "at", "gram").toPandas()
    at = usual["at"].to_numpy(np.int64)
    bit = np.left_shift(np.uint64(1), (at % 64).astype(np.uint64)).astype(kind)
    for place in _places(usual["gram"].to_numpy(np.int64).view(np.uint64), cells):
        np.bitwise_or.at(table, (place, at // 64), bit)
    filled = np.array([(table[:, i // 64] >> kind(i % 64) & kind(1)).mean()
                       for i in range(len(languages))])
    return Filters(languages, table, filled ** PROBES)


def language_hits(filters: Filters, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hits by text and language, less chance hits; n-grams by text)."""
    count, n = np.zeros((len(texts), len(filters.languages))), np.zeros(len(texts))
    for grams, owner in _grams(texts):
        masks = None
        for place in _places(grams, len(filters.cells)):
            own = filters.cells[place]
            masks = own if masks is None else masks & own
        n += np.bincount(owner, minlength=len(texts))
        if filters.cells.dtype == np.uint8:
            seen = np.bincount(owner * 256 + masks[:, 0], minlength=256 * len(texts))
            bits = (np.arange(256)[:, None] >> np.arange(len(filters.languages))) & 1
            count += seen.reshape(len(texts), 256) @ bits
        else:
            for i in range(len(filters.languages)):
                bit = masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)
                count[:, i] += np.bincount(owner, bit, minlength=len(texts))
    corrected = (count - n[:, None] * filters.chance) / np.maximum(1 - filters.chance, 1e-9)
    return np.maximum(corrected, 0), n


def _predictor(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                hits, n = language_hits(filters, piece.column("text"))
                best = hits.argmax(axis=1)
                most = hits[np.arange(len(best)), best]
                names = [filters.languages[i] for i in best]
                kept = [c for c in piece.schema.names if c not in ("text", "lettered")]
                lettered = np.asarray(piece.column("lettered").fill_null(False))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept),
                     pa.array(np.where(lettered, names, UNKNOWN).tolist(), pa.string()),
                     pa.array(np.where(lettered, most / np.maximum(hits.sum(axis=1), 1e-9), 0.0)),
                     pa.array(np.where(lettered, np.minimum(most / np.maximum(n, 1), 1.0), 0.0))],
                    names=[*kept, "lang_pred", "score", "coverage"])
    return run


def detect_language(docs: DataFrame, filters: Filters, id_col: str = "doc_id",
                    text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row: id, lang_pred, score, coverage; with `carry`, all columns come along
    as the struct `row` in place of the id.

    `score` is the winner's share of all languages' hits, `coverage` the part of the text's
    n-grams that the winner knows. Texts that are null or hold no letter, and all texts if
    nothing was learnt, are `und` with 0 in both. Equal hits go to the first language by name.
    Null ids and repeated rows are judged like others; without `carry`, other columns are not
    read.
    """
    ship(docs.sparkSession)
    name, source = ("row", F.struct("*")) if carry else (id_col, F.col(id_col))
    read = docs.select(
        source.alias(name), F.col(text_col).alias("text"),
        F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    if not filters.languages:
        return read.select(name, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("coverage"))
    schema = T.StructType([read.schema[name], *T.StructType.fromDDL(
        "lang_pred string, score double, coverage double").fields])
    return read.mapInArrow(_predictor(filters), schema)
