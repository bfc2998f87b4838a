"""Codes against plain Python integers, and float products against them."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tallyhouse.llm.vector_codes import assign, books_digest, compress, exact_products, limbs

SCHEMA = "vec_id long, embedding array<double>, label string, part int, code string, cells int, vec long"


def by_hand(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = [[q[p * width:(p + 1) * width] for p in range(parts)] for _, q, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            for k, members in groups.items():
                books[p][k] = [sum(x) // len(x) for x in zip(*members)]
    out, by_label = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    return sorted(((i, code, e, by_label[label]) for i, code, e, label in out), key=str), books


@pytest.mark.parametrize("scale", [0.3, 3e4])
def test_codes_match_plain_integers(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i * 3 - 20, (rng.normal(size=8) * scale).tolist(), [None, "a", "b"][i % 3]) for i in range(60)]
    rows += [rows[2], rows[2], (500, rows[5][1], "a"), (501, rows[5][1], None), (-400, None, "a"),
             (-399, [], "a"), (-398, [1.0, None] * 4, "b"), (-397, [float("nan")] * 8, "b"),
             (-396, [float("inf")] + [0.0] * 7, "b"), (7, [1.0] * 12, "a"), (8, [1.0] * 6, "a"),
             (None, [0.5] * 8, "c"), (-5, [0.0] * 8, None), (1, rows[0][1], "z")]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    got, books = compress(docs, parts=4, entries=16, rounds=3)
    expected, plain = by_hand(rows, 4, 16, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert books.tolist() == plain
    assert books_digest(books) == books_digest(np.array(plain))


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(1, [0.1] * 4, "a", 1, "x", 1, 1), (2, [0.1] * 4, "a", 1, "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got, books = compress(docs)
    assert books.shape == (4, 2, 1)
    assert {tuple(r) for r in got.collect()} == {(1, "00000000", 0, 0), (2, "00000000", 0, 0)}
    got, books = compress(docs.limit(0))
    assert got.count() == 0 and books.size == 0 and got.columns == ["vec_id", "code", "error", "label_error"]


def test_errors_beyond_a_long_are_null(spark):
    rows = [(1, [1e300] * 4, "a", 1, "x", 1, 1), (2, [-1e300] * 4, "a", 1, "x", 1, 1), (3, [2.5] * 4, "b", 1, "x", 1, 1)]
    got, _ = compress(spark.createDataFrame(rows, SCHEMA), entries=1, rounds=1)
    assert {r["vec_id"]: (r["error"], r["label_error"]) for r in got.collect()}[1] == (None, None)


@pytest.mark.parametrize("size", [5, 20, 29, 33])
def test_limb_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-(1 << size) + 1, (1 << size), (40, 8)) for _ in "ab")
    b >>= max(0, size - 26)  # results stay in int64
    assert (exact_products(a, b) == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()
    parts = limbs(a, 22)
    assert (sum(x.astype(np.int64) << 22 * i for i, x in enumerate(parts)) == a).all()
    assert all(np.abs(x).max() <= 1 << 22 for x in parts)


def test_ties_take_the_lower_entry():
    at, far = assign(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5], [5, 5]]))
    assert at.tolist() == [0, 2] and far.tolist() == [1, 0]
