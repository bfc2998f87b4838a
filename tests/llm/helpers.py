"""Small corpora with every awkward row, and plain-Python words."""

from __future__ import annotations

import random
import re

CLASHING = "doc long, key long, row string, n int, band int, words string, anchor long, at int"


def words(text, fold=False):
    text = text or ""
    if fold:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall("[^\x20\x09-\x0d]+", text)


def sentence(rng, length, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" for _ in range(length)]


def corpus(seed=3, groups=12):
    """(id, text): originals, exact and edited copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    rows, passage = [], sentence(rng, 30)
    for _ in range(groups):
        base = sentence(rng, rng.randrange(20, 80))
        rows.append(base)
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append(copy)
    for i in range(0, len(rows), 5):
        cut = rng.randrange(len(rows[i]))
        rows[i] = rows[i][:cut] + passage[rng.randrange(4):] + rows[i][cut:]
    texts = [(" " if i % 3 else "\n\t ").join(r) for i, r in enumerate(rows)]
    texts += [None, "", " \n\t", "one", "One", "two words", " ".join(sentence(rng, 3000, 90)), "ÀB"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 7, texts[j]) for i, j in enumerate(order)]


def frame(spark, rows, extra=True):
    """Documents of (doc_id, text), with columns whose names operators use inside."""
    made = spark.createDataFrame(
        [(i, t, "xx", "s", None if t is None else len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    return made.selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}"
                                  for c in CLASHING.split(", ")]) if extra else made
