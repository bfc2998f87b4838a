"""Every training-data query against its SQL on the smallest tables, and the pipeline's stages."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests import oracle

import corpus_pipeline
from tallyhouse.llm import queries as llm
from tallyhouse.llm.common import held_out

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    connection = oracle.connect(FOLDER)
    assert oracle.compare(llm.queries()[name](spark, FOLDER), connection, llm.oracle_sql()[name]) is None


def test_held_out_language_and_quality(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = llm.op7_language_id(spark, FOLDER).join(docs, "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() > 0.95 * found.count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = llm.op2_quality(spark, FOLDER).join(labels, "doc_id").filter("held_out")
    assert scored.filter("predicted = quality").count() > 0.9 * scored.count()


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, FOLDER)
        left = {r["doc_id"] for r in result.select("doc_id").collect()}
        assert left <= ids
        if number < len(corpus_pipeline.STAGES) - 1:
            assert result.schema == docs.schema
            docs, ids = spark.createDataFrame(result.toPandas(), docs.schema), left
    assert left == ids


def test_stages_on_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"wort{i}" for i in range(40))
    rows = [(1, long, "de", None, None), (1, long, "de", None, None), (2, long + " mehr", "de", "s", 1),
            (None, "ohne nummer", None, None, None), (3, None, None, None, None), (4, "12", "de", "s", 2),
            (5, "ganz anderes zeug hier drin", "de", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.known_language(spark, docs, FOLDER)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "1", "2", "5", "None"]
    kept = spark.createDataFrame(kept.collect(), schema)
    kept = corpus_pipeline.one_of_each_group(spark, kept, FOLDER)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "5", "None"]
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.without_repeats(
        spark, docs, FOLDER).collect()}
    assert cut[2] == ("mehr", 4) and cut[5] == ("ganz anderes zeug hier drin", 9) and cut[1][0] == long
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_held_out_is_a_third(spark):
    share = spark.range(3000).select(held_out("id").cast("int").alias("x")).agg({"x": "avg"}).first()[0]
    assert 0.3 < share < 0.37


def test_language_stage_rejects_what_no_filter_knows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, "Съешь же ещё этих мягких французских булок", None, "x", 1),
         (-2, "これは学習されていない言語の文章です。何も知られていません", "ja2", "x", 1), (-3, "A.", None, "x", 1)],
        docs.schema).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.known_language(spark, docs.unionByName(odd), FOLDER)
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {-1, -2} and -3 in ids
    lettered = docs.filter(F.col("text").rlike("\\p{L}")).count()
    assert len(ids) == lettered + 1
