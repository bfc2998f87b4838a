"""Tables of a run in the shared folder, and the given tables by name."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import shared_folder, ship


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of one of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


class Scratch:
    """Tables written between the steps of one run; what is lost is read again from there.

    `drop` deletes a table that no later step reads. Tables that the returned frame still
    reads stay until their folder in `spark.checkpoint.dir` is cleared.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = ship(spark)
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.option("compression", "zstd").parquet(path)
        self._release()
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, which it does on garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def held_out(id_col: str):
    """True for the third of the documents that nothing is learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1
