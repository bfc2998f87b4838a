"""Session settings the library relies on, applied to a session the caller owns."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime re-planning does the skew and join-strategy work at scale. A hot order or
# product id is split by the skew join even where that costs one extra shuffle. Ids in
# order compress well: the usual 64 MB of shuffled lines are over four million rows, which
# a stage of several joins holds several times over in one task.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin UTC and adaptive execution; instants are only ever shifted by an explicit zone."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def short_methods(spark: SparkSession):
    """Runs what parses whole rows operator by operator.

    As one stage it makes a method too long for the virtual machine to compile. Other stages
    lose by it, so it holds only for jobs started inside.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    usual = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, usual)


_LOCAL_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and tasks are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(f"file://{tempfile.mkdtemp(prefix='tallyhouse-')}")
    return _LOCAL_FOLDER[0]


def ship(spark: SparkSession) -> SparkSession:
    """Gives Python workers this package, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_tallyhouse_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyhouse-"), "tallyhouse_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._tallyhouse_shipped = True
    return spark
