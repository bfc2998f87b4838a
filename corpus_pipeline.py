"""Corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns
of documents, except the last. Null ids stay in every stage, since no decision can name them;
empty and null texts leave with the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch, table
from tallyhouse.llm.decontaminate import contaminated
from tallyhouse.llm.language import UNKNOWN, detect_language, fit_filters
from tallyhouse.llm.near_dedup import near_dedup
from tallyhouse.llm.packing import pack
from tallyhouse.llm.substring_dedup import substring_dedup


# Held-out documents of the learnt languages have a coverage of 0.56 and more, texts of other
# scripts under 0.01; texts of fewer characters hold too few n-grams to tell, and filters of
# fewer labelled texts know too little to reject by.
MIN_COVERAGE, MIN_CHARS, MIN_LABELLED = 0.05, 16, 100


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learnt from the labelled ones.

    Texts without letters go, and texts of which the best language's filter knows less than
    `MIN_COVERAGE` of the n-grams, unless they have under `MIN_CHARS` characters or there are
    under `MIN_LABELLED` labelled texts.
    """
    filters = fit_filters(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = detect_language(docs, filters, carry=True)
    learnt = docs.filter(F.col("lang").isNotNull()).limit(MIN_LABELLED).count() == MIN_LABELLED
    covered = (F.col("coverage") >= MIN_COVERAGE) | (F.char_length("row.text") < MIN_CHARS) | F.lit(not learnt)
    return found.filter((F.col("lang_pred") != UNKNOWN) & covered).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates, and one row of each id."""
    ids = near_dedup(docs.select("doc_id", "text")).filter(
        "kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words that smaller documents hold; what is empty then goes."""
    cut = substring_dedup(docs.select("doc_id", "text")).filter(
        "kept_text is not null").select("doc_id", F.col("kept_text").alias("_kept"))
    changed = F.col("_kept").isNotNull()
    new = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("_kept").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return docs.join(cut, "doc_id", "left").filter(~changed | (F.col("_kept") != "")).withColumns(
        new).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    leaks = contaminated(docs, items).select("doc_id").distinct()
    leaks = Scratch(spark, "leaks").put("ids", leaks)
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket and batch."""
    return pack(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# SuperMinHash groups, learnt languages and digests of cut texts are not SQL; the tests hold
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.put(name, docs)
    return docs
