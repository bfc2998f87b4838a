"""The operators applied to whole tables, by query name, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import held_out, table
from tallyhouse.llm.decontaminate import contaminated
from tallyhouse.llm.filter_audit import filter_audit
from tallyhouse.llm.language import detect_language, fit_filters
from tallyhouse.llm.near_dedup import near_dedup
from tallyhouse.llm.neighbours import nearest
from tallyhouse.llm.packing import pack
from tallyhouse.llm.quality import fit_quality, score_quality
from tallyhouse.llm.simhash import simhash_dedup
from tallyhouse.llm.substring_dedup import substring_dedup
from tallyhouse.llm.token_counts import count_tokens, load_vocabulary
from tallyhouse.llm.url_filter import judge_urls
from tallyhouse.llm.vector_codes import books_digest, compress
from tallyhouse.llm.web_archive import archived


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are 80 % alike."""
    return near_dedup(table(spark, folder, "documents", "doc_id", "text"), words=2).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from two thirds of the labelled ones."""
    docs = table(spark, folder, "documents", "doc_id", "text", "n_chars")
    labels = table(spark, folder, "labels", "doc_id", "quality").filter(~held_out("doc_id"))
    return score_quality(docs, fit_quality(docs, labels)).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(table(spark, folder, "embeddings", "vec_id", "embedding"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict on every page's URL."""
    return judge_urls(table(spark, folder, "pages", "page_id", "url")).drop("block_score")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's length bucket and batch."""
    return pack(table(spark, folder, "documents", "doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 13-word passages that smaller documents hold."""
    return substring_dedup(table(spark, folder, "documents", "doc_id", "text")).drop("kept_text")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from two thirds of the labelled ones."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    filters = fit_filters(docs.filter(~held_out("doc_id")).select(
        F.col("doc_id").alias("key"), "text", "lang"))
    return detect_language(docs, filters).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_web_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, written to WARC packages and read back."""
    return archived(table(spark, folder, "pages", "page_id", "url", "html")).drop("url")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pre-tokens and tokens of every document."""
    return count_tokens(table(spark, folder, "documents", "doc_id", "text"), load_vocabulary())


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the benchmark items whose passages they hold."""
    return contaminated(table(spark, folder, "documents", "doc_id", "text"),
                        table(spark, folder, "benchmark", "item_id", "text"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from every language, in every order."""
    return filter_audit(table(spark, folder, "documents", "doc_id", "text", "lang"),
                        table(spark, folder, "labels", "doc_id", "quality", "toxic"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's four-part code, and its error."""
    coded, books = compress(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))
    return coded.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash of every document and its component at three bits."""
    return simhash_dedup(table(spark, folder, "documents", "doc_id", "text")).drop("class_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_neighbours, op4_url_filter,
                                      op5_packing, op6_substring_dedup, op7_language_id,
                                      op8_web_archive, op9_token_counts, op10_decontamination,
                                      op11_filter_audit, op12_vector_codes, op13_simhash)}


def oracle_sql() -> dict[str, str]:
    from tallyhouse.llm import oracles

    return oracles.STATEMENTS
