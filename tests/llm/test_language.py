"""Language filters: exact recall of what they hold, held-out accuracy, odd texts."""

import random

import numpy as np
import pyarrow as pa
from tests.llm.helpers import frame

from tallyhouse.llm.language import detect_language, fit_filters, language_hits


def tongue(letters, seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
                     for _ in range(rng.randrange(5, 40))) for _ in range(n)]


def learnt(spark):
    rows = [(i, t, lang) for lang, letters in (("aa", "abcde"), ("bb", "cdefgß"), ("cc", "жзик"))
            for i, t in enumerate(tongue(letters, lang, 150))]
    return fit_filters(spark.createDataFrame(rows, "key long, text string, lang string"))


def test_unseen_texts_and_odd_ones(spark):
    filters = learnt(spark)
    assert filters.languages == ["aa", "bb", "cc"]
    texts = tongue("abcde", 7, 60) + tongue("cdefgß", 8, 60) + tongue("жзик", 9, 60)
    rows = list(enumerate(texts)) + [(900, None), (901, "12 34 !"), (902, ""), (None, "жзик зики")]
    got = detect_language(frame(spark, rows), filters).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    truth = ["aa"] * 60 + ["bb"] * 60 + ["cc"] * 60
    assert np.mean([found[i] == t for i, t in enumerate(truth)]) > 0.97
    assert [found[i] for i in (900, 901, 902, None)] == ["und", "und", "und", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got)
    whole = detect_language(frame(spark, rows), filters, carry=True).select("row.*")
    assert whole.columns == frame(spark, rows).columns and whole.count() == len(rows)


def test_more_than_eight_languages(spark):
    letters = {f"l{i:02d}": chr(0x430 + 3 * i) + chr(0x431 + 3 * i) + "ab" for i in range(10)}
    rows = [(i, t, lang) for lang, own in letters.items() for i, t in enumerate(tongue(own, lang, 40))]
    filters = fit_filters(spark.createDataFrame(rows, "key long, text string, lang string"))
    hits, n = language_hits(filters, pa.array([tongue(own, "new", 1)[0] for own in letters.values()]))
    assert list(hits.argmax(axis=1)) == list(range(10)) and (n > 0).all()


def test_nothing_to_learn_from(spark):
    filters = fit_filters(spark.createDataFrame([(1, "abc", None)], "key long, text string, lang string"))
    row = detect_language(frame(spark, [(1, "abc")]), filters).first()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert detect_language(frame(spark, []), learnt(spark)).count() == 0
