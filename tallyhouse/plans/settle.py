"""Cutting lineage in shared storage, so lost executors cost no recomputation of inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tallyhouse.session import shared_folder


def settled(frame: DataFrame) -> DataFrame:
    """The frame written once as Parquet under the session's ``spark.checkpoint.dir``.

    Columnar, so later readers fetch only the columns they use. Without that setting a
    cluster session is refused; a local one gets a temporary folder.
    """
    spark = frame.sparkSession
    target = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(target)
    return spark.read.schema(frame.schema).parquet(target)
