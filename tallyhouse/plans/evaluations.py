"""Backtest results kept in a table, so that a series is scored again only when it changed.

A result is known by a fingerprint of what was scored: the days, the values, the folds and the
horizon. Any other history of the same series has another fingerprint, so nothing has to be
invalidated. Results of a history that is no longer asked for stay in the table, one row for
each series, target, method and change.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.scoring import pooled, score_totals
from tallyhouse.plans.methods import Method, method_folds
from tallyhouse.plans.settle import settled

KEY = ("series_id", "target", "method", "version", "fingerprint")
SCORES = ("folds", "days", "mae", "wape_percent", "absolute_error_total", "absolute_actual_total")
SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("series_id", "target")],
    T.StructField("version", T.LongType()), T.StructField("fingerprint", T.StringType()),
    *[T.StructField(c, T.LongType()) for c in SCORES[:2]],
    *[T.StructField(c, T.DoubleType()) for c in SCORES[2:]],
    T.StructField("method", T.StringType()),
])


def fingerprint(horizon: int) -> Column:
    """Digest of a row of histories; a double's text tells it from every other double."""
    def told(column: str) -> Column:
        return F.concat_ws(",", F.transform(
            column, lambda v: F.coalesce(v.cast("string"), F.lit("null"))))

    return F.sha2(F.concat_ws(
        "|", F.lit(str(horizon)), F.col("first_day").cast("string"), told("origins"),
        told("values")), 256)


@dataclass(frozen=True)
class EvaluationStore:
    """A folder in shared storage, partitioned by method."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """Every stored result once; two runs at a time may have stored the same one."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path).dropDuplicates(list(KEY))

    def evaluate(self, histories: DataFrame, methods: Sequence[Method], horizon: int) -> DataFrame:
        """`backtest.evaluate` of the methods on the histories, with ``reused`` beside it.

        ``histories`` are those of `backtest.fold_histories`. A method is fitted only on rows
        without a stored result; one whose results are all there is not called.
        """
        names = [m.name for m in methods]
        marked = histories.withColumn("fingerprint", fingerprint(horizon))
        asked = marked.select("series_id", "target", "fingerprint", F.inline(F.array(*[
            F.struct(F.lit(m.name).alias("method"), F.lit(m.version).cast("bigint").alias("version"))
            for m in methods])))
        known = self.rows().filter(F.col("method").isin(names)).select(
            *KEY, F.lit(True).alias("reused"))
        asked = settled(asked.join(known, list(KEY), "left").select(
            *KEY, F.coalesce("reused", F.lit(False)).alias("reused")))
        missing = asked.filter("not reused").drop("reused")
        open_names = {r["method"] for r in missing.select("method").distinct().collect()}
        simple = [m for m in methods if m.name in open_names and m.expression is not None]
        fitted = [m for m in methods if m.name in open_names and m.paths is not None]
        # Expressions are cheap and share a pass; each fitted method gets its own rows.
        for group in [g for g in (simple, *[[m] for m in fitted]) if g]:
            own = missing.filter(F.col("method").isin([m.name for m in group]))
            rows = marked.join(
                own.select("series_id", "target").distinct(), ["series_id", "target"], "left_semi")
            scored = pooled(score_totals(method_folds(rows.drop("fingerprint"), group, horizon)),
                            "series_id", "target", "method")
            self._append(scored.join(own, ["series_id", "target", "method"]))
        return asked.join(self.rows().filter(F.col("method").isin(names)), list(KEY)).select(
            "series_id", "target", "method", *SCORES, "reused")

    def _append(self, scored: DataFrame) -> None:
        scored.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA]).write.mode(
            "append").partitionBy("method").parquet(self.path)
