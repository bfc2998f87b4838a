"""Benchmark passages in documents by spaced seeds, in DataFrame functions alone.

A mask says which words of a run count; a run's seed is the hash of those words. `MASKS` is
lossless for the passages looked for: whichever two of thirteen words are replaced, one of
the masks fits between them somewhere. Seeds of documents and benchmark items are joined, and
around a hit the words are compared one to one along the alignment that the hit gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch

MASKS = ("11101011", "110100111")
PASSAGE = 13
SUBSTITUTIONS = 2
MIN_ITEM = 5
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)")),
                       lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: str) -> Column:
    picked = [F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when((at >= 0) & (at + len(mask) <= F.size(words)), F.xxhash64(F.lit(mask), *picked))


def _seeds(frame: DataFrame, masks: list[str]) -> DataFrame:
    """A row per word and mask: `at`, the seed there and the one before, beside the id alone."""
    each = frame.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    at, words = F.col("at"), F.col("words")
    both = F.explode(F.array(*[
        F.struct(_seed(words, at, m).alias("seed"), _seed(words, at - 1, m).alias("before"))
        for m in masks])).alias("s")
    return each.select(frame.columns[0], "at", both).select(
        frame.columns[0], "at", "s.*").filter("seed is not null")


def _broadcast(frame: DataFrame, size: Column) -> DataFrame:
    """The frame, marked for broadcasting if the `size` of all its rows is small enough."""
    total = frame.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row per document and benchmark item in it: id, item, start, n_matched, n_item_words.

    A document holds an item if `PASSAGE` consecutive words of the item stand in it at the same
    distances with at most `SUBSTITUTIONS` of them replaced; an item of fewer words must be
    there whole and unchanged, and one under `MIN_ITEM` words is told from chance by nothing
    and left out. Words are runs of letters and digits in lower case. The row gives the best
    alignment: most matching words, then the first; `start` is the document word at which the
    item's first word falls (negative if the document cuts the item off).

    Null and empty texts and null ids on either side give no row; rows that repeat an id count
    as one. Columns not named are not read. Seeds of the benchmark, its words and the alignments
    found are broadcast up to `BROADCAST_BYTES` of each; beyond, both sides are shuffled. No row
    of a seed holds words.
    """
    items = benchmark.select(
        F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("words")
    ).filter(F.col("item").isNotNull() & (F.size("words") >= MIN_ITEM))
    longest = min(map(len, MASKS))
    short = sorted(r[0] for r in items.filter(F.size("words") < longest).select(
        F.size("words")).distinct().collect())
    masks = [*MASKS, *("1" * n for n in short)]
    name = F.length(F.col("item").cast("string")) + ROW_BYTES
    seeds = _broadcast(_seeds(items, masks).select(
        "item", F.col("at").alias("item_at"), "seed", F.col("before").alias("item_before")), name)
    read = docs.select(F.col(id_col).alias("doc"), word_hashes(F.col(text_col)).alias("words")) \
        .filter("doc is not null")
    hits = _seeds(read, masks).join(seeds, "seed").filter(
        ~F.coalesce(F.col("before") == F.col("item_before"), F.lit(False)))
    # Each alignment is looked at once; only then do the words of both sides come in.
    found = Scratch(docs.sparkSession, "decontaminate").put("alignments", hits.select(
        "doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    ids = found.select("doc").distinct()
    texts = read.join(_broadcast(ids, F.length(F.col("doc").cast("string")) + ROW_BYTES),
                      "doc", "left_semi")
    item_words = _broadcast(items.select("item", F.col("words").alias("item_words")).distinct(),
                            name + 8 * F.size("item_words"))
    shift, n = F.col("shift"), F.size("item_words")
    beside = F.slice("words", F.greatest(shift, F.lit(0)) + 1,
                     F.greatest(n + F.least(shift, F.lit(0)), F.lit(0)))
    aligned = found.join(item_words, "item").join(texts, "doc").select(
        "doc", "item", "shift", "item_words", beside.alias("beside")
    ).select("doc", "item", "shift", F.size("item_words").alias("n"), F.expr(
        "transform(item_words, (x, i) -> if(get(beside, i + least(shift, 0)) <=> x, 1, 0))"
    ).alias("same"))
    length = f"least(n, {PASSAGE})"
    need = f"if(n < {PASSAGE}, n, {PASSAGE - SUBSTITUTIONS})"
    total = "aggregate(slice(same, s + 1, {}), 0, (a, x) -> a + x)"
    held = aligned.filter(F.expr(
        f"exists(sequence(0, n - {length}), s -> {total.format(length)} >= {need})"))
    return held.select(
        "doc", "item", "n", "shift", F.expr("aggregate(same, 0, (a, x) -> a + x)").alias("matched")
    ).groupBy("doc", "item").agg(
        F.max(F.struct("matched", (-F.col("shift")).alias("early"), "n")).alias("best")
    ).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col),
        (-F.col("best.early")).cast("long").alias("start"),
        F.col("best.matched").cast("long").alias("n_matched"),
        F.col("best.n").cast("long").alias("n_item_words"))
