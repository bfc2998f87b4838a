"""Neighbours against brute force: recall, exact products, ties, odd vectors."""

import numpy as np

from tallyhouse.llm import neighbours
from tallyhouse.llm.neighbours import hilbert_keys, nearest


def test_hilbert_curve_visits_neighbouring_cells():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * axes, indexing="ij"), -1).reshape(-1, axes)
        key = hilbert_keys(cells, bits)
        assert sorted(key) == list(range(side ** axes))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v int, pid int")


def by_force(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in sorted(rows.items())]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted(((-float((v * w).sum()), j) for j, w in good if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def test_recall_and_exact_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "PART_BLOCKS", 2)
    rng = np.random.default_rng(0)
    rows = {i: (rng.normal(size=16) * rng.uniform(0.5, 2)).tolist() for i in range(1200)}
    for i in range(300, 360):
        rows[i] = rows[7]  # one vector many times
    bad = {2001: None, 2020: [], 2002: [0.0] * 16, 2003: [float("nan")] + [1.0] * 15,
           2004: [None] + [1.0] * 15, 2005: [1.0] * 4, 2040: [float("inf")] * 16, None: [1.0] * 16}
    got = nearest(frame_of(spark, [(i, v, 0, 1, 2) for i, v in {**rows, **bad}.items()]
                           + [(5, rows[5], 0, 1, 2)])).collect()
    truth, found = by_force(rows, 20), {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(truth) and all(len(v) == 20 for v in found.values())
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in truth[q]}) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    for q, own in found.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        for j, s in own:
            assert abs(s - float(np.dot(np.float32(rows[q]).astype(float),
                                        np.float32(rows[j]).astype(float)))) < 1e-9


def test_few_and_none(spark):
    few = frame_of(spark, [(i, [1.0, float(i)], 0, 1, 2) for i in (0, 3, 5)])
    assert [tuple(r) for r in nearest(few).orderBy("rank").collect()] == [
        (0, 1, 3, 1.0), (0, 2, 5, 1.0)]
    assert nearest(frame_of(spark, [])).count() == 0
