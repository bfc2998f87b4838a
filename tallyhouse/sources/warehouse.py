"""Stored tables as partitioned Parquet, committed batch by batch.

Every table is partitioned by import batch, and a batch exists once its row in
``import_batches`` says ``completed``. That row is written last, so readers see all of an
import or nothing, and files of a failed attempt are never read.

One import runs at a time: it claims its batch by creating a file that must not exist yet, and
is refused while an earlier claim has no batch row. Ids that continue from the stored maximum
are therefore never given out twice. The file system has to create files exclusively, as HDFS,
local disks and object stores with conditional writes do.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import schemas
from tallyhouse.operators import daily

_BATCH = T.StructField("import_batch_id", T.LongType(), True)
_MONTH = T.StructField("local_month", T.StringType(), True)
_ZONE = T.StructField("zone", T.StringType(), True)
# Null where the order was stored before digests were.
_DIGEST = T.StructField("line_digest", T.StringType(), True)
# Rows of file offsets that may be sent to all tasks: about 16 MB of paths.
MOST_FILES = 100_000


class ImportInProgress(Exception):
    """Another import has claimed its batch and not finished."""


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str

    def path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    # --- reading ---------------------------------------------------------------------

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where = self._path(path)
        return self._system(where).exists(where)

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        if not self._exists(self.path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _committed(self, name: str, schema: T.StructType) -> DataFrame:
        done = self.import_batches().filter(F.col("status") == "completed").select(
            F.col("batch_id").alias("import_batch_id"))
        return self._table(name, schema).join(done, "import_batch_id", "left_semi")

    def orders(self) -> DataFrame:
        """Committed orders, with their batch, month and line digest."""
        return self._committed("orders", _with(schemas.ORDERS, _DIGEST, _BATCH, _MONTH))

    def order_items(self) -> DataFrame:
        return self._committed("order_items", _with(schemas.ORDER_ITEMS, _BATCH, _MONTH))

    def products(self) -> DataFrame:
        return self._committed("products", _with(schemas.PRODUCTS, _BATCH))

    def issues(self) -> DataFrame:
        return self._committed("issues", _with(schemas.ISSUES, _BATCH))

    def written(self, name: str, batch_id: int) -> DataFrame:
        """What one batch wrote to a table, committed or not."""
        schema = {"orders": _with(schemas.ORDERS, _DIGEST, _MONTH), "products": schemas.PRODUCTS,
                  "issues": schemas.ISSUES}[name]
        return self.spark.read.schema(schema).parquet(
            self.path(name, f"import_batch_id={batch_id}"))

    def import_files(self) -> DataFrame:
        return self._committed("import_files", _with(schemas.IMPORT_FILES, _BATCH))

    def day_totals(self, zone: str = schemas.DEFAULT_ZONE) -> DataFrame:
        """Committed totals by local day and channel, added up from those of each batch.

        Orders are read only of batches imported in another zone or before totals were kept.
        """
        kept = self._committed("day_totals", _with(schemas.DAY_TOTALS, _BATCH, _ZONE)).filter(
            F.col("zone") == zone)
        done = {r["batch_id"] for r in self.import_batches().filter(
            F.col("status") == "completed").select("batch_id").distinct().collect()}
        without = sorted(done - {
            r["import_batch_id"] for r in kept.select("import_batch_id").distinct().collect()})
        columns = ("day", "channel", *daily.MEASURES)
        parts = kept.select(*columns)
        if without:
            orders = self.orders().filter(F.col("import_batch_id").isin(without))
            parts = parts.unionByName(daily.day_totals(orders, zone, "channel").select(*columns))
        return daily.merged(parts, "day", "channel")

    def import_batches(self) -> DataFrame:
        """The latest state of every batch that was ever started."""
        return self._table("import_batches", schemas.IMPORT_BATCHES)

    # --- writing ---------------------------------------------------------------------

    def _claims(self) -> set[int]:
        folder = self._path(self.path("_claims"))
        system = self._system(folder)
        if not system.exists(folder):
            return set()
        return {int(f.getPath().getName()) for f in system.listStatus(folder)
                if f.getPath().getName().isdigit()}

    def claim_batch(self) -> int:
        """The next batch id, for this import alone, or `ImportInProgress`.

        Whoever lists the claims before another import makes its own finds that file there
        when it creates the same one; whoever lists them later sees it open.
        """
        rows = {r["batch_id"] for r in self.import_batches().select("batch_id").distinct().collect()}
        claims = self._claims()
        if unfinished := sorted(claims - rows):
            raise ImportInProgress(
                f"batch {unfinished[0]} is not finished; abandon_batch({unfinished[0]}) gives it up")
        batch_id = max(rows | claims, default=0) + 1
        file = self._path(self.path("_claims", str(batch_id)))
        try:
            self._system(file).create(file, False).close()
        except Py4JJavaError as error:
            if self._system(file).exists(file):
                raise ImportInProgress(f"batch {batch_id} was claimed just now") from error
            raise
        return batch_id

    def release_claim(self, batch_id: int) -> None:
        """Takes back a claim of an import that was never started."""
        file = self._path(self.path("_claims", str(batch_id)))
        self._system(file).delete(file, False)

    def abandon_batch(self, batch_id: int) -> None:
        """Closes the batch of an import whose driver is gone, as failed; its files are never read."""
        self.append_batch((batch_id, None, None, None, "failed", datetime.now(timezone.utc),
                           "abandoned"))

    def append(self, frame: DataFrame, name: str, batch_id: int, *by: str) -> None:
        # Each batch owns its partition, so a repeated attempt replaces only its own files.
        target = self.path(name, f"import_batch_id={batch_id}")
        writer = frame.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(target)

    def append_batch(self, row: tuple) -> None:
        self.spark.createDataFrame([row], schemas.IMPORT_BATCHES).coalesce(1).write.mode(
            "append").parquet(self.path("import_batches"))

    def staged(self, frame: DataFrame, batch_id: int, step: str) -> DataFrame:
        """Write an intermediate table into shared storage and read it back columnar."""
        target = self.path("_staging", str(batch_id), step)
        frame.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)

    def clear_staging(self, batch_id: int) -> None:
        """Deletes what a finished import staged."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("_staging", str(batch_id)))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def numbered(self, staged: DataFrame, column: str, base: int) -> DataFrame:
        """Dense ids above ``base`` for a staged table, from each row's place in its file.

        The same files always give the same ids and no ordering of the table is needed. There
        is one offset per file; up to `MOST_FILES` of them go to all tasks, so that the table
        itself is not shuffled, and more are joined like any table.
        """
        placed = staged.select(
            "*", F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.row_index").alias("_index"))
        counts = placed.groupBy("_path").agg(F.count(F.lit(1)).alias("_rows"))
        before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_path", F.coalesce(F.sum("_rows").over(before), F.lit(0))
                               .alias("_before"))
        few = starts.limit(MOST_FILES + 1).collect()
        if len(few) <= MOST_FILES:
            starts = F.broadcast(self.spark.createDataFrame(few, starts.schema))
        number = F.col("_before") + F.col("_index") + F.lit(base + 1)
        return placed.join(starts, "_path").withColumn(
            column, number.cast("bigint")).drop("_path", "_index", "_before")
