"""Bucket boundaries against every choice, batches against their budget."""

import itertools
import random
from collections import defaultdict

import numpy as np
from tests.llm.helpers import corpus, frame, words

from tallyhouse.llm.packing import bucket_boundaries, pack


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 5)
        got = bucket_boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(k)
                   for c in itertools.combinations(lengths[:-1], min(r, len(lengths) - 1)))
        assert len(got) <= k and padding(lengths, counts, got) == best


def test_batches(spark):
    rows = corpus() + [(9999, "a"), (9999, "a"), (None, "b c")]
    for shard_rows in (100_000, 5):
        got = pack(frame(spark, rows), buckets=4, token_budget=256, shard_rows=shard_rows).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted(
            (str(i), len(words(t))) for i, t in rows)
        batches = defaultdict(list)
        for r in got:
            if r["n_tokens"]:
                batches[r["batch"]].append(r)
                assert r["padded_to"] - r["n_tokens"] == r["n_padding"] >= 0
            else:
                assert r["batch"] is None and r["n_padding"] == 0
        for own in batches.values():
            assert len({r["padded_to"] for r in own}) == 1 and own[0]["n_in_batch"] == len(own)
            assert len(own) == 1 or own[0]["padded_to"] * len(own) <= 256


def test_empty(spark):
    assert pack(frame(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in pack(frame(spark, [(1, None)])).collect()] == [
        (0, None, None, None, None, 0)]


def test_one_long_text_leaves_other_boundaries_exact(spark):
    rows = [(i, "w " * (2 * (i % 10) + 3)) for i in range(100)] + [(100, "w " * 200_001)]
    got = pack(frame(spark, rows), buckets=16).collect()
    assert len(got) == len(rows) and sum(r["n_padding"] for r in got) == 0
    assert {r["padded_to"] for r in got} == {*range(3, 22, 2), 200_001}
