"""What an import asks of a source format.

An adapter turns files into parsed rows and says nothing about storage; the import job checks,
joins and stores them without knowing the format.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.operators import ingest
from tallyhouse.sources import exports


class SourceAdapter(ABC):
    """One format. ``source`` is stored with every order, which is unique within it."""

    source: str

    @abstractmethod
    def manifest(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """A row per file: at least ``path, name, checksum``; other columns are the adapter's own."""

    @abstractmethod
    def transactions(self, spark: SparkSession, paths: list[str], manifest: DataFrame) -> DataFrame:
        """Rows as `ingest.parse_transactions` gives them, with `exports.row_keys`."""

    @abstractmethod
    def items(self, spark: SparkSession, paths: list[str], manifest: DataFrame) -> DataFrame:
        """Rows as `ingest.parse_items` gives them, with `exports.row_keys`."""

    @abstractmethod
    def summary(self, spark: SparkSession, paths: list[str], manifest: DataFrame) -> DataFrame:
        """Text rows with the bound columns of an items summary, with `exports.row_keys`."""


@dataclass(frozen=True)
class TillExports(SourceAdapter):
    """UTF-16 TAB-separated exports. ``multiline`` is that of `exports.read_export`."""

    source: str = "till"
    multiline: bool | None = None

    def manifest(self, spark, paths):
        return exports.file_manifest(spark, paths)

    def _raw(self, spark, paths, role, manifest):
        return exports.read_export(spark, paths, role, manifest, self.multiline)

    def transactions(self, spark, paths, manifest):
        return ingest.parse_transactions(self._raw(spark, paths, "transactions", manifest))

    def items(self, spark, paths, manifest):
        return ingest.parse_items(self._raw(spark, paths, "items_detail", manifest))

    def summary(self, spark, paths, manifest):
        return self._raw(spark, paths, "items_summary", manifest)
