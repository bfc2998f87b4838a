"""Passages that repeat across documents, by prefix-partitioned suffix trees.

A suffix is a window of a text: `min_words` words from some word on. Only suffixes that two
documents may share get into a tree:

1. In every window the `ANCHOR_WORDS`-word run of smallest hash is its anchor. Equal windows
   have equal anchors, and neighbouring windows mostly the same one, so a fifth of the
   positions stands for all. Anchors of one document alone are dropped.
2. Suffixes are partitioned by a prefix of variable length: the anchor's words, or, where an
   anchor has more spans than a task should hold, the whole window.
3. Each partition builds its subtrees by sorting suffixes by their words and comparing
   neighbours: a node of depth `min_words` or more is a stretch of neighbours whose common
   prefix is as long. The node's first document is the smallest one below it.
4. A document's words under windows whose node starts in a smaller document are repeats;
   joined windows give maximal repeats.

Texts with equal words are one text before all this, and spans are aggregated to distinct
ones before they are dealt to trees, so neither copies nor a passage in many documents makes
a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch
from tallyhouse.llm.wordstream import Words, grams, gram_starts, mix, pieces, words_of

ANCHOR_WORDS = 5
BLOCK_ROWS = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space after each word, start and end of each word in them)."""
    size = words.end - words.start
    start = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(start, size) + inner] = words.data[np.repeat(words.start, size) + inner]
    return out, start, start + size


def _runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows by anchor: (anchor's hash, first window's word, number of windows, text)."""
    at, text = gram_starts(words.bounds, length)
    none = np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    run = min(ANCHOR_WORDS, length)
    short = grams(words.hash, run)
    owner = at + np.lib.stride_tricks.sliding_window_view(
        short, length - run + 1)[at].argmin(axis=1)
    first = np.flatnonzero(np.concatenate(
        [[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
    return short[owner[first]], at[first], np.diff(np.append(first, len(at))), text[first]


def _lists(values: np.ndarray, text: np.ndarray, texts: int, kind: pa.DataType) -> pa.Array:
    bounds = np.searchsorted(text, np.arange(texts + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _summariser(length: int):
    """(doc, n_words, digest of its words, its anchors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = words_of(piece.column("text"))
                digests = _digests(words)
                anchor, _, _, text = _runs(words, length)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), pa.array(np.diff(words.bounds), pa.int64()),
                     pa.array(digests, pa.string()), _tags(digests),
                     _lists(anchor.view(np.int64), text, piece.num_rows, pa.int64())],
                    names=["doc", "n_words", "sha", "tag", "anchors"])
    return run


def _digests(words: Words) -> list[str]:
    """Digest of each text's words, joined by one space."""
    data, start, end = _spaced(words)
    return [hashlib.sha256(data[start[a]: end[b - 1]].tobytes() if b > a else b"").hexdigest()
            for a, b in zip(words.bounds[:-1], words.bounds[1:])]


def _tags(digests: list[str]) -> pa.Array:
    """The first eight bytes of digests, enough to tell the rows of one id apart."""
    return pa.array(np.array([int(d[:16], 16) for d in digests], np.uint64).view(np.int64))


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the rows whose text has the tag that came with its id."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            own = _tags(_digests(words_of(piece.column("text"))))
            yield piece.filter(pc.equal(own, piece.column("tag")))


def _spanner(length: int):
    """Spans of the anchors that other documents hold too, as text and as two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = words_of(piece.column("text"))
                anchor, first, count, text = _runs(words, length)
                lists = piece.column("shared")
                of = np.repeat(np.arange(piece.num_rows), np.asarray(lists.value_lengths()))
                shared = np.asarray(lists.flatten()).view(np.uint64)

                def named(values, texts):
                    return mix(values + mix(texts.astype(np.uint64)))

                kept = np.isin(named(anchor, text), named(shared, of))
                anchor, first, count, text = anchor[kept], first[kept], count[kept], text[kept]
                if not len(anchor):
                    continue
                data, start, end = _spaced(words)
                a, b = start[first], end[first + count + length - 2]
                size = b - a
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                spans = pa.StringArray.from_buffers(
                    len(size), pa.py_buffer(offsets),
                    pa.py_buffer(data[np.repeat(a, size) + inner]))
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c).take(pa.array(text)) for c in ("doc", "tag")),
                     pa.array(first - words.bounds[text], pa.int32()),
                     pa.array(count, pa.int32()), pa.array(anchor.view(np.int64)), spans,
                     *(pa.array(k.view(np.int64)) for k in _span_keys(words, first, count, length))],
                    names=["doc", "tag", "start", "windows", "anchor", "span", "k1", "k2"])
    return run


def _span_keys(words: Words, first: np.ndarray, count: np.ndarray, length: int):
    """Two hashes of each run of count + length - 1 words."""
    upto = first + count + length - 1
    for salt in (np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)):
        mixed = mix(words.hash ^ salt)
        total = np.zeros(len(first), np.uint64)
        for i in range(int(count.max()) + length - 1):
            live = np.flatnonzero(first + i < upto)
            total[live] = mix(total[live] * np.uint64(0x9E3779B97F4A7C15) + mixed[first[live] + i])
        yield total


def _nodes(group: np.ndarray, matrix: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Smallest document under each suffix's node of full depth.

    Suffixes (rows of word hashes, with the partition each lies in) are sorted as in a suffix
    array; the depth of the node that joins two neighbours is their common prefix, and a
    node is a stretch of neighbours joined at full depth.
    """
    order = np.lexsort([*matrix.T[::-1], group])
    same = (matrix[order][1:] == matrix[order][:-1]) & (
        group[order][1:] == group[order][:-1])[:, None]
    depth = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    top = np.concatenate([[True], depth < matrix.shape[1]])
    least = np.minimum.reduceat(low[order], np.flatnonzero(top))
    out = np.empty_like(low)
    out[order] = least[np.cumsum(top) - 1]
    return out


def _suffixes(block: pa.Table | pa.RecordBatch, length: int):
    """Windows of the spans: (words of all spans, first word of each window, its span)."""
    words = words_of(block.column("span") if isinstance(block, pa.RecordBatch)
                     else block.column("span").combine_chunks())
    at, span = gram_starts(words.bounds, length)
    return words, at, span


def _tree_builder(length: int):
    """Spans that some document holds after another one: hashes, first document per window."""
    def built(block: pa.Table) -> pa.RecordBatch:
        words, at, span = _suffixes(block, length)
        low, high = (np.asarray(block.column(c)) for c in ("low", "high"))
        matrix = words.hash[at[:, None] + np.arange(length)]
        first = _nodes(np.asarray(block.column("anchor"))[span], matrix, low[span])
        bounds = np.searchsorted(span, np.arange(block.num_rows + 1))
        useful = np.flatnonzero(np.minimum.reduceat(first, bounds[:-1]) < high)
        lists = pa.ListArray.from_arrays(
            pa.array(bounds, pa.int32()), pa.array(first, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [block.column("k1").combine_chunks(), block.column("k2").combine_chunks(), lists],
            names=["k1", "k2", "firsts"]).take(pa.array(useful))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a block ends where an anchor does."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS)
                at += part.num_rows
                anchors = np.asarray(part.column("anchor"))
                edges = np.flatnonzero(anchors[1:] != anchors[:-1])
                if waiting and waiting[-1].column("anchor")[-1].as_py() != int(anchors[0]):
                    if sum(w.num_rows for w in waiting) >= BLOCK_ROWS:
                        yield built(pa.Table.from_batches(waiting))
                        waiting = []
                elif len(edges) and sum(w.num_rows for w in waiting) >= BLOCK_ROWS:
                    cut = int(edges[0]) + 1
                    yield built(pa.Table.from_batches([*waiting, part.slice(0, cut)]))
                    waiting, part = [], part.slice(cut)
                waiting.append(part)
        if waiting:
            yield built(pa.Table.from_batches(waiting))
    return run


def _window_lister(length: int):
    """Every window of the spans by itself, under two hashes of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "span"):
                words, at, span = _suffixes(piece, length)
                keys = [grams(mix(words.hash ^ np.uint64(salt)), length)[at].view(np.int64)
                        for salt in (1, 2)]
                place = np.arange(len(at)) - np.searchsorted(span, span)
                taken = piece.select(["k1", "k2", "low", "high"]).take(pa.array(span))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(place, pa.int32()), *map(pa.array, keys)],
                    names=["k1", "k2", "low", "high", "place", "w1", "w2"])
    return run


def _cutter(length: int):
    """Removes covered words: (doc, tag of the text's words, n_removed, kept text, its digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = words_of(piece.column("text"))
                lists = piece.column("starts")
                of = np.repeat(np.arange(piece.num_rows), np.asarray(lists.value_lengths()))
                begin = words.bounds[of] + np.asarray(lists.flatten())
                inside = begin + length <= words.bounds[of + 1]
                step = np.zeros(len(words.hash) + length + 1, np.int64)
                np.add.at(step, begin[inside], 1)
                np.add.at(step, begin[inside] + length, -1)
                left = np.cumsum(step)[: len(words.hash)] == 0
                data, start, end = _spaced(words)
                keep = np.repeat(left, end - start + 1)
                data = data[keep]
                upto = np.concatenate([[0], np.cumsum(keep)])
                edges = np.append(start, len(keep))[words.bounds]
                texts = [data[upto[a]: max(upto[a], upto[b] - 1)].tobytes()
                         for a, b in zip(edges[:-1], edges[1:])]
                counts = np.concatenate([[0], np.cumsum(~left)])[words.bounds]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), piece.column("tag"), pa.array(np.diff(counts), pa.int64()),
                     pa.array([t.decode("utf-8") for t in texts], pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                    names=["doc", "tag", "n_removed", "kept_text", "kept_sha256"])
    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13,
    max_group: int = 200_000,
) -> DataFrame:
    """One row per id: id, n_words, n_removed, kept_sha256, kept_text.

    Words under a window of `min_words` words that also starts in a document with a smaller
    id are removed; windows are judged on the texts as given. `kept_text` is null where
    nothing was removed, else the kept words joined by one space; `kept_sha256` is the digest
    of the kept words so joined in either case. An anchor with more than `max_group` distinct
    spans is partitioned by whole windows instead.

    Null, empty and short texts lose nothing. Rows with a null id are neither source nor
    target of a removal and give a row each. Rows that repeat an id are one document: every
    window of any of them counts against larger ids, and the row whose words have the smallest
    digest is returned, cut by its own windows. Texts of any length are read whole. Columns
    other than the two named are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    summary = scratch.put("summaries", texts.mapInArrow(
        _summariser(min_words), "doc long, n_words long, sha string, tag long, anchors array<long>"))

    named = summary.filter("doc is not null")
    firsts = named.filter(F.col("n_words") >= min_words).groupBy("sha").agg(
        F.min("doc").alias("first_doc"))
    sole = named.select("doc", "tag", "anchors").join(
        firsts.select(F.col("first_doc").alias("doc")).distinct(), "doc", "left_semi")
    held = sole.select("doc", "tag", F.explode("anchors").alias("anchor"))
    # Stored first: a join with a table is split where an anchor is hot, one with an aggregate is not.
    common = scratch.put("common", held.groupBy("anchor").agg(
        F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("anchor"))
    shared = scratch.put("shared", held.join(common, "anchor", "left_semi").groupBy("doc", "tag").agg(
        F.collect_set("anchor").alias("shared")))
    digests = scratch.put("digests", summary.drop("anchors"))
    firsts = scratch.put("firsts", firsts)
    scratch.drop("summaries", "common")
    affected = scratch.put("affected", texts.join(shared, "doc").mapInArrow(
        _matcher, "doc long, text string, tag long, shared array<long>"))

    spans = scratch.put("spans", affected.mapInArrow(
        _spanner(min_words),
        "doc long, tag long, start int, windows int, anchor long, span string, k1 long, k2 long"))
    distinct = scratch.put("distinct", spans.groupBy("anchor", "span", "k1", "k2").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high")))
    large = scratch.put("large", distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(
        F.col("n") > max_group).select("anchor"))
    trees = distinct.join(large, "anchor", "left_anti").repartition("anchor") \
        .sortWithinPartitions("anchor").mapInArrow(
        _tree_builder(min_words), "k1 long, k2 long, firsts array<long>")
    windows = distinct.join(large, "anchor", "left_semi").mapInArrow(
        _window_lister(min_words),
        "k1 long, k2 long, low long, high long, place int, w1 long, w2 long")
    least = windows.groupBy("w1", "w2").agg(F.min("low").alias("first"))
    whole = windows.join(least, ["w1", "w2"]).groupBy("k1", "k2").agg(
        F.max("high").alias("high"),
        F.array_sort(F.collect_list(F.struct("place", "first"))).alias("at")
    ).select("k1", "k2", F.expr("transform(at, x -> x.first)").alias("firsts"), "high") \
        .filter(F.array_min("firsts") < F.col("high")).drop("high")
    nodes = scratch.put("nodes", trees.union(whole))
    scratch.drop("distinct")

    covered = spans.select("doc", "tag", "start", "k1", "k2").join(nodes, ["k1", "k2"]).select(
        "doc", "tag", F.expr("filter(transform(firsts, (f, i) -> if(f < doc, start + i, -1)), s -> s >= 0)")
        .alias("starts")).filter("size(starts) > 0")
    starts = scratch.put("starts", covered.groupBy("doc", "tag").agg(
        F.flatten(F.collect_list("starts")).alias("starts")))
    scratch.drop("spans", "nodes")
    cut = affected.select("doc", "tag", "text").join(starts, ["doc", "tag"]).mapInArrow(
        _cutter(min_words), "doc long, tag long, n_removed long, kept_text string, kept_sha256 string")
    cut = scratch.put("cut", cut.groupBy("doc", "tag").agg(F.min(
        F.struct("kept_sha256", "n_removed", "kept_text")).alias("cut")))
    scratch.drop("affected", "starts")

    one = digests.filter("doc is not null").groupBy("doc").agg(F.min(F.struct("sha", "tag", "n_words")).alias("own")).select(
        "doc", "own.sha", "own.tag", "own.n_words").join(firsts, "sha", "left").join(cut, ["doc", "tag"], "left")
    copy = F.col("first_doc") < F.col("doc")
    result = one.select(
        F.col("doc").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut.n_removed", F.lit(0)))
        .alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("cut.kept_sha256", "sha"))
        .alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("cut.kept_text")).alias("kept_text"))
    nameless = digests.filter("doc is null").select(
        F.col("doc").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_removed"),
        F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return result.union(nameless)
