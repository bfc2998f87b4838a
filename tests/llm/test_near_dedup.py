"""Near duplicates against all pairs, and signatures against the element-wise algorithm."""

import numpy as np
import pytest
from tests.llm.helpers import corpus, frame, words

from tallyhouse.llm.near_dedup import near_dedup, superminhash
from tallyhouse.llm.wordstream import mix


def shingles(text, size):
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else
                     [tuple(w[i:i + size]) for i in range(len(w) - size + 1)])


def by_pairs(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(
        sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {i: (len(sets[i]), root[i], root[i] == i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, size):
    rows = corpus()
    got = near_dedup(frame(spark, rows), words=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == by_pairs(
        rows, size, 80)
    assert len({r["component_id"] for r in got}) < len(got)


def test_chain_of_copies_without_a_common_hub_is_one_component(spark):
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(30):  # each text shares most with its neighbours only
        rows.append((i, " ".join([f"e{j}" for j in range(i)] + base[i:])))
    got = near_dedup(frame(spark, rows), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == by_pairs(
        rows, 2, 80)


def test_nulls_and_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "A B C"), (3, None)]
    got = sorted((tuple(r)[:4] for r in near_dedup(frame(spark, rows), words=2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True),
                          (None, 2, None, True), (None, 0, None, True)], key=str)
    assert near_dedup(frame(spark, [])).count() == 0


def element_wise(values, slots):
    """The published algorithm: one element after another, ranks in order, early stop."""
    table = [np.inf] * slots
    for v in values:
        order = list(range(slots))
        for rank in range(slots):
            x = int(mix(np.array([v + 0x9E3779B97F4A7C15 * (rank + 1) & (1 << 64) - 1],
                                 np.uint64))[0])
            pick = rank + ((x & 0xFFFFFFFF) * (slots - rank) >> 32)
            order[rank], order[pick] = order[pick], order[rank]
            table[order[rank]] = min(table[order[rank]], (rank << 32) | (x >> 32))
    return table


def test_signatures_equal_the_element_wise_algorithm():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 40, 300]
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    text = np.repeat(np.arange(len(sizes)), sizes)
    got = superminhash(np.concatenate(sets), text, len(sizes), 24)
    assert [list(map(int, row)) for row in got] == [element_wise(map(int, s), 24) for s in sets]


def test_rows_of_one_id_with_different_texts_belong_together(spark):
    rng = np.random.default_rng(6)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 10 ** 6, 60)) for _ in range(3))
    near_b, near_a, near_c = b + " more", a + " more", c + " more"
    for rows, component in [
        ([(1, a), (1, b), (2, near_b), (3, c)], {1: 1, 2: 1, 3: 3}),
        ([(5, a), (5, b), (2, near_b), (4, near_a), (3, c), (9, near_c)], {2: 2, 3: 3, 4: 2, 5: 2, 9: 3}),
        ([(7, a), (7, b), (7, c), (7, c), (3, near_c), (8, b), (1, near_a)], {1: 1, 3: 1, 7: 1, 8: 1}),
    ]:
        for turn in range(2):
            dealt = frame(spark, rows[::-1] if turn else rows).repartition(3 + turn)
            got = {r["doc_id"]: r["component_id"] for r in near_dedup(dealt, words=2).collect()}
            assert got == component


def test_a_very_long_text_counts_whole(spark):
    long = " ".join(f"q{i}" for i in range(250_000))
    rows = [(1, long), (2, long.replace("q7 ", "x ")), (3, long[: len(long) // 2])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(frame(spark, rows), words=2).collect()}
    assert got[2] == (249_999, 1) and got[3][1] == 3
