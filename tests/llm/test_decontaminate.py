"""Benchmark passages: every pattern of two substitutions, and what must not be found."""

import itertools

from tests.llm.helpers import frame

from tallyhouse.llm import decontaminate
from tallyhouse.llm.decontaminate import contaminated

ITEM = [f"q{i}" for i in range(24)]


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").selectExpr(
        "*", "1 as seed", "2 as words")


def test_any_two_substitutions_in_thirteen_words_are_found(spark):
    rows = []
    for n, (a, b) in enumerate(itertools.combinations(range(13), 2)):
        piece = ITEM[5:18]
        piece[a] = piece[b] = "other"
        rows.append((n, "Before, " + " ".join(piece).upper() + "! after"))
    rows += [(500, " ".join(ITEM[:10])), (501, " ".join(x for x in ITEM[:13][::-1])),
             (502, " ".join(["z"] * 40)), (503, None), (504, ""), (None, " ".join(ITEM))]
    got = contaminated(frame(spark, rows), items(spark, " ".join(ITEM), None, "")).collect()
    assert {r["doc_id"] for r in got} == set(range(78))
    assert {r["n_matched"] for r in got} == {11} and {r["start"] for r in got} == {-4}


def test_short_items_and_best_alignment(spark):
    docs = frame(spark, [(1, "x a b c d e y"), (2, "a b c d z"), (3, " ".join(ITEM + ITEM)),
                         (3, " ".join(ITEM + ITEM)), (4, "a b")])
    got = contaminated(docs, items(spark, "A, b c d E", "a b", " ".join(ITEM))).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, 5, 5), (3, 2, 0, 24, 24)]


def test_empty_tables(spark):
    assert contaminated(frame(spark, []), items(spark, "a b c d e f")).count() == 0
    assert contaminated(frame(spark, [(1, "a b c d e f")]), items(spark).filter("false")).count() == 0


def test_seed_rows_hold_no_words_and_every_join_may_shuffle(spark, monkeypatch):
    assert decontaminate._seeds(spark.sql("select 1 as doc, array(1L, 2L, 3L, 4L, 5L) as words"),
                                ["111"]).columns == ["doc", "at", "seed", "before"]
    long = [f"v{i}" for i in range(400)]
    rows = [(1, " ".join(["x"] * 30 + long[50:300])), (2, " ".join(long[:10])),
            (3, " ".join(ITEM)), (4, "")]
    got = []
    for most in (decontaminate.BROADCAST_BYTES, -1):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got.append(sorted(tuple(r) for r in contaminated(
            frame(spark, rows), items(spark, " ".join(long), " ".join(ITEM))).collect()))
    assert got == [[(1, 0, -20, 250, 400), (3, 1, 0, 24, 24)]] * 2
