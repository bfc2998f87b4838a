"""Repeated passages against a dictionary of all windows."""

import hashlib
from collections import defaultdict

import pytest
from tests.llm.helpers import corpus, frame, words

from tallyhouse.llm.substring_dedup import substring_dedup


def by_windows(rows, size):
    first = defaultdict(set)
    cut = [(i, words(t)) for i, t in rows]
    for i, w in cut:
        for s in range(len(w) - size + 1):
            first[tuple(w[s:s + size])].add(i)
    out = {}
    for i, w in cut:
        gone = set()
        for s in range(len(w) - size + 1):
            if min(first[tuple(w[s:s + size])]) < i:
                gone.update(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("max_group", [200_000, 1])
def test_cuts_match_all_windows(spark, max_group):
    rows = corpus(5)
    got = substring_dedup(frame(spark, rows), max_group=max_group).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got
            } == by_windows(rows, 13)
    assert any(0 < r["n_removed"] < r["n_words"] for r in got)
    for r in got:
        if r["kept_text"] is not None:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_repeats_inside_one_text_stay_and_overlaps_join(spark):
    loop = " ".join(["la"] * 40)
    rows = [(1, loop), (2, "x " + loop + " y"), (3, "la " * 12)]
    got = substring_dedup(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got
            } == by_windows(rows, 13)
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 40, 3: 0}


def test_nulls_and_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(20))
    rows = [(4, text), (4, text), (None, text), (9, text), (9, text), (5, None), (6, "")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in
                  substring_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(4, 20, 0), (9, 20, 20), (5, 0, 0), (6, 0, 0), (None, 20, 0)], key=str)
    assert substring_dedup(frame(spark, [])).count() == 0


def test_rows_of_one_id_with_different_texts_are_cut_by_their_own_windows(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    one = shared + " " + " ".join(f"a{i}" for i in range(5))
    for size in range(28, 34):  # whichever of the two digests is smaller
        two = " ".join(f"b{size}x{i}" for i in range(size))
        rows = [(1, "x " + shared), (2, one), (2, two), (3, two)]
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(
            frame(spark, rows)).collect()}
        digests = {t: hashlib.sha256(t.encode()).hexdigest() for t in (one, two)}
        assert got[2] == ((25, 20) if digests[one] < digests[two] else (size, 0))
        assert got[3] == (size, size) and got[1] == (21, 0)
