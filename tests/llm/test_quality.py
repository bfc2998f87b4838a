"""The factorisation machine: the identity, held-out accuracy, odd rows."""

import numpy as np
from tests.llm.helpers import frame, sentence

from tallyhouse.llm.quality import Features, Machine, _margins, fit_quality, score_quality


def test_pair_terms_by_the_identity():
    rng = np.random.default_rng(4)
    machine = Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)), None, None)
    x = Features(np.array([0, 2, 5, 1, 2]), rng.normal(size=5), np.array([0, 3, 5]))
    for row, got in enumerate(_margins(machine, x)[0]):
        a, b = x.bounds[row], x.bounds[row + 1]
        at, value = x.at[a:b], x.value[a:b]
        want = machine.bias + machine.weight[at] @ value + sum(
            machine.factor[at[i]] @ machine.factor[at[j]] * value[i] * value[j]
            for i in range(b - a) for j in range(i))
        assert abs(want - got) < 1e-12


def rows_of(n, seed):
    import random
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(sentence(rng, rng.randrange(5, 60)))
        out.append((i, text if good else text.upper().replace(" ", "!! "), int(good)))
    return out


def test_unseen_texts_and_odd_ones(spark):
    known = rows_of(240, 1)
    labels = spark.createDataFrame([(i, q) for i, _, q in known] + [(1, None), (7777, 1), (None, 0)],
                                   "doc_id long, quality int")
    machine = fit_quality(frame(spark, [(i, t) for i, t, _ in known]), labels)
    new = rows_of(90, 2)
    rows = [(i, t) for i, t, _ in new] + [(100, None), (101, ""), (None, "abc"), (0, new[0][1])]
    got = score_quality(frame(spark, rows), machine).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    found = {r["doc_id"]: r["predicted"] for r in got}
    assert np.mean([found[i] == q for i, _, q in new]) > 0.95


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a b")])
    machine = fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert machine is None
    assert [tuple(r) for r in score_quality(docs, machine).collect()] == [(1, 0.5, 1)]
