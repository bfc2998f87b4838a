"""The audit against every order applied document by document, and the walk against subsets."""

from collections import Counter
from itertools import permutations

import numpy as np
from tests.llm.helpers import words

from tallyhouse.llm.filter_audit import filter_audit, walk

SCHEMA = "doc_id long, text string, lang string, part string, mask int, digest string, good int"


def failed(text, doc, rows):
    w, text = words(text), text or ""
    fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w),
             100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
             any(c in "#$%&*|" for c in text),
             doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)]
    return "".join(x for x, bad in zip("ABCDE", fails) if bad)


def by_hand(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = {}, Counter()
    facts = [(lang or "", d, failed(t, d, rows)) for d, t, lang in rows]
    for part in {p for p, _, _ in facts}:
        mine = [(d, f) for p, d, f in facts if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone),
                    sum(f == x for _, f in mine), sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone))
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_audit_matches_documents_taken_one_by_one(spark):
    long = " ".join(f"w{i}é" for i in range(120))
    texts = [long, long, long + " #", "A B C", "a " * 150, "\t" + long.upper(), "", None, "a\x0bb\x0cc 100%",
             " \n", "x|y", "É" * 30, " ".join(f"v{i % 90}" for i in range(110)), " ".join(
                 f"z{i % 4000}" for i in range(300_000))]
    rows = [(i, t, [None, "", "de", "fr"][i % 4]) for i, t in enumerate(texts)]
    rows += [(0, long, "de"), (0, long, None), (20, long, "fr"), (None, long, "fr"), (None, None, "de"),
             (20, long, "fr"), (3, "other", "de"), (7, "", None)]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (20, None, 1), (None, 1, 1), (5, 1, None), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 5) for r in rows], SCHEMA)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == by_hand(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels).filter("good_lost + toxic_lost = 0").count() == 600


def test_walk_counts_survivors_of_every_subset():
    cells = np.random.default_rng(1).integers(0, 50, (2, 3, 32))
    states = walk(cells)
    for subset in range(32):
        alive = [m for m in range(32) if m & subset == 0]
        assert (states[..., subset] == cells[..., alive].sum(axis=-1)).all()
