"""Token counts against a search per word."""

import random

import pytest
from tests.llm.helpers import corpus, frame, words

from tallyhouse.llm.token_counts import LEAD, LONGEST, Vocabulary, count_tokens, load_vocabulary
import numpy as np


def by_word(vocabulary, word):
    best_of = {}
    for p, s in zip(vocabulary.pieces, vocabulary.scores):
        best_of[p] = max(s, best_of.get(p, -1e9))
    text = LEAD + word
    best = [(0.0, 0)]
    for d in range(1, len(text) + 1):
        own = (best[d - 1][0] + vocabulary.byte_score, best[d - 1][1] + 1)
        for n in range(1, min(d, 60) + 1):
            s = best_of.get(text[d - n:d])
            if s is not None:
                x = (best[d - n][0] + s, best[d - n][1] + 1)
                if x[0] > own[0] or (x[0] == own[0] and x[1] < own[1]):
                    own = x
        best.append(own)
    return best[-1][1]


def small_vocabulary():
    rng = random.Random(3)
    letters = ["w", "x", "é", "1", "2", "3", "▁", "▁w"]
    pieces = {c.encode() for c in letters} | {
        "".join(rng.choice(letters) for _ in range(rng.randrange(2, 4))).encode() for _ in range(60)}
    pieces = sorted(pieces)
    return Vocabulary(pieces, np.array([-1.0 - (i * 7 % 11) / 2 for i in range(len(pieces))]), -30.0)


def test_counts_match_a_search_per_word(spark):
    vocabulary, rows = small_vocabulary(), corpus() + [(None, "w1é w2é"), (0, "€ w")]
    got = count_tokens(frame(spark, rows), vocabulary).collect()
    want = sorted((str(i), len(words(t)), sum(by_word(vocabulary, w.encode()) for w in words(t)))
                  for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_pretokens"], r["n_tokens"]) for r in got) == want
    assert count_tokens(frame(spark, []), vocabulary).count() == 0


def test_long_words_are_counted_whole(spark):
    vocabulary, rng = small_vocabulary(), random.Random(5)
    texts = ["wé" * LONGEST, "".join(rng.choice("wxé123€") for _ in range(5000)), "w" * LONGEST, "x" * (LONGEST + 1)]
    rows = [(i, t) for i, t in enumerate([*texts, f"w1 {texts[1]} é {texts[0]}"])]
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in count_tokens(frame(spark, rows), vocabulary).collect()}
    assert got == {i: (len(words(t)), sum(by_word(vocabulary, w.encode()) for w in words(t))) for i, t in rows}


def test_public_vocabulary():
    pytest.importorskip("sentencepiece")
    vocabulary = load_vocabulary()
    assert len(vocabulary.pieces) == len(vocabulary.scores) > 30_000
    assert all(p for p in vocabulary.pieces) and vocabulary.byte_score < vocabulary.scores.min()
