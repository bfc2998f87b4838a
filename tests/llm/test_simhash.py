"""SimHash components against all pairs, and its parts against plain definitions."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from tests.llm.helpers import corpus, frame, words

from tallyhouse.llm import simhash
from tallyhouse.llm.simhash import deal_units, flips, link_groups, runs_of_blocks, simhash_dedup


def fingerprint(text):
    w = words(text, True)
    runs = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    hashes = [xxhash.xxh64(" ".join(r).encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_pairs(rows, most=3):
    """{(id, fingerprint): component} of rows without null ids."""
    nodes = sorted({(i, fingerprint(t)) for i, t in rows if i is not None})
    root = list(range(len(nodes)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(nodes)), 2):
        if nodes[x][0] == nodes[y][0] or (nodes[x][1] ^ nodes[y][1]).bit_count() <= most:
            a, b = sorted((top(x), top(y)))
            root[b] = a
    return {(i, f"{f:016x}"): nodes[top(x)][0] for x, (i, f) in enumerate(nodes)}


def alike(rng, groups, size):
    """Texts of one word a line: copies whose fingerprints differ in few bits."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(200)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(200)] = f"x{rng.randrange(99)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [8192, 3])
def test_components_match_all_pairs(spark, tile):
    rng = random.Random(8)
    texts = alike(rng, 6, 25)
    rows = corpus() + [(1000 + i * 3, t) for i, t in enumerate(texts)]
    rows += [(7, texts[0]), (7, "other words altogether here"), (2000, None), (1003, texts[1]),
             (2001, "a b"), (2002, "A B"), (3000, " ".join(f"q{i % 700}" for i in range(250_000)))]
    got = simhash_dedup(frame(spark, rows), tile=tile).collect()
    expected = by_pairs(rows)
    assert {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got} == expected
    assert len(got) == len(expected)
    assert len(set(expected.values())) < len(expected) - 30


def test_null_ids_and_empty_tables(spark):
    got = simhash_dedup(frame(spark, [(None, "a b c"), (None, "a b c"), (5, "a b c"), (4, ""), (3, None)]))
    assert sorted(map(str, (tuple(r)[1:] for r in got.collect()))) == sorted(map(str, [
        (f"{fingerprint('a b c'):016x}", None, None)] * 2 + [
        (f"{fingerprint('a b c'):016x}", 5, 5), ("0" * 16, 3, 3), ("0" * 16, 3, 3)]))
    assert simhash_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", simhash.LAYOUTS)
def test_every_fingerprint_finds_all_within_three_bits(parts):
    """Whatever the costs, units add up to four, so some part differs in fewer bits than it has units."""
    rng = np.random.default_rng(parts)
    blocks = rng.integers(0, 256, (300, 8)).astype(np.uint8)
    shares = simhash.shares_by_distance(rng.integers(0, 900, (8, 256)) ** 3, 3)
    units, cost = deal_units(blocks, shares, 10 ** 7, parts, 3)
    assert (units.sum(axis=1) == 4).all() and (cost > 0).all()
    bounds = [(8 * r.start, 8 * r.stop) for r in runs_of_blocks(parts)]
    for mine in units:
        for flipped in rng.integers(0, 64, (40, 3)):
            apart = [len({b for b in flipped.tolist() if lo <= b < hi}) for lo, hi in bounds]
            assert any(a < u for a, u in zip(apart, mine))


def test_units_are_dealt_at_the_least_cost():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (20, 8)).astype(np.uint8)
    shares = simhash.shares_by_distance(rng.integers(0, 9, (8, 256)) ** 4, 3)
    units, cost = deal_units(blocks, shares, 10 ** 6, 4, 3)

    def price(q, dealt):
        total = simhash.LOOKUP_COST * 4
        for p, u in enumerate(dealt):
            x, y = (shares[b][blocks[q, b]] for b in (2 * p, 2 * p + 1))
            total += simhash.LOOKUP_COST * len(flips(16, u)) + 10 ** 6 * sum(
                x[i] * y[j] for i in range(4) for j in range(4) if i + j < u)
        return total

    deals = [d for d in np.ndindex(5, 5, 5, 5) if sum(d) == 4]
    for q in range(20):
        assert np.isclose(cost[q], min(price(q, d) for d in deals))
        assert np.isclose(cost[q], price(q, units[q].tolist()))


def test_correlated_bits_share_a_block():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (4000, 64))
    tied = rng.permutation(64)[:8]
    bits[:, tied] = bits[:, tied[:1]]
    order = simhash.correlated_blocks((bits.T @ bits).astype(float), 4000)
    assert sorted(order.tolist()) == list(range(64)) and set(order[:8]) == set(tied.tolist())


def test_forest_links_what_pairs_link(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(9)
    group = np.sort(rng.integers(0, 6, 90))
    prints = rng.integers(0, 64, 90).astype(np.uint64)
    asks, found = rng.random(90) < 0.6, rng.random(90) < 0.7
    a, b = link_groups(group, prints, asks, found, 1)
    root = np.arange(90)
    for _ in range(90):
        for x in np.flatnonzero(asks):
            for y in np.flatnonzero(found & (group == group[x])):
                if (int(prints[x]) ^ int(prints[y])).bit_count() <= 1:
                    root[x] = root[y] = min(root[x], root[y])
    mine = np.arange(90)
    for x, y in sorted(zip(a, b), key=lambda t: t[1]):
        mine[x] = mine[y]
    assert (mine == root).all() and len(a) < 90
