"""Reading till exports: UTF-16, TAB separated, all text, one header line per file.

Files are grouped by encoding, header and line ending, so a folder may mix them, and each
group is one splittable CSV scan. Only the bound columns are selected; the personal-data
columns an export carries are never read into a table.
"""

from __future__ import annotations

import csv
import hashlib
import re
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: export columns by role (bound, required) ------------------------
BOUND = {
    "transactions": (
        "Date", "Time", "Time Zone", "Gross Sales", "Discounts", "Net Sales",
        "Transaction ID", "Payment ID", "Event Type", "Source", "Dining Option",
    ),
    "items_detail": (
        "Date", "Time", "Time Zone", "Category", "Item", "Qty", "Price Point Name",
        "Modifiers Applied", "Product Sales", "Discounts", "Net Sales", "Transaction ID",
        "Event Type",
    ),
    "items_summary": (
        "Item Name", "Item Variation", "Category", "Items Sold", "Items Refunded",
        "Units Sold", "Product Sales", "Refunds", "Discounts & Comps", "Net Sales",
        "Gross Sales",
    ),
}
REQUIRED = {
    "transactions": (
        "Date", "Time", "Time Zone", "Gross Sales", "Discounts", "Net Sales",
        "Transaction ID", "Event Type", "Source",
    ),
    "items_detail": (
        "Date", "Time", "Time Zone", "Item", "Qty", "Product Sales", "Transaction ID",
    ),
    "items_summary": ("Item Name", "Items Sold", "Product Sales", "Net Sales"),
}
FILE_NAMES = {
    "transactions": "transactions",
    "items_detail": "items",
    "items_summary": "item-sales-summary",
}
# --- end of fixed values --------------------------------------------------------------

ROW_KEYS = ("_file", "_split", "_seq")
_HEADER_BYTES = 1 << 20
# Larger files are hashed as a stream instead of being held in memory as one value.
WHOLE_FILE_BYTES = 256 << 20


class SourceFormatError(ValueError):
    """A file is not a UTF-16 TAB-separated export."""


class SourceSchemaError(ValueError):
    """A readable file lacks required columns."""


# --- files ---------------------------------------------------------------------------


def file_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, name, length, checksum, encoding, header, line_end`` of every file.

    ``encoding`` is ``UTF-16LE``, ``UTF-16BE``, ``UTF-8`` (a re-saved file) or NULL.
    """
    listed = spark.read.format("binaryFile").load(paths)
    files = listed.filter(F.col("length") <= WHOLE_FILE_BYTES).select(
        "path", "length", F.sha2("content", 256).alias("checksum"),
        F.substring("content", 1, _HEADER_BYTES).alias("head"),
    )
    large = listed.filter(F.col("length") > WHOLE_FILE_BYTES).select("path", "length")
    if not large.isEmpty():
        files = files.unionByName(large.repartition("path").mapInPandas(
            _stream_digests(), "path string, length bigint, checksum string, head binary"))

    mark = F.hex(F.substring("head", 1, 3))
    encoding = (
        F.when(mark.startswith("FFFE"), F.lit("UTF-16LE"))
        .when(mark.startswith("FEFF"), F.lit("UTF-16BE"))
        .when(mark == "EFBBBF", F.lit("UTF-8"))
    )
    # The first line is cut out in whole UTF-16 units before it is decoded.
    units = F.substring(F.hex("head"), 5, 4 * _HEADER_BYTES)
    feed = {"UTF-16LE": ("0A00", "0D00"), "UTF-16BE": ("000A", "000D")}
    header, line_end = F.lit(None).cast("string"), F.lit("\n")
    for name, (newline, carriage) in feed.items():
        line = F.regexp_extract(units, f"^((?:[0-9A-F]{{4}})*?)(?:{carriage})?{newline}", 1)
        whole = F.when(line == "", units).otherwise(line)
        # A first line that the bytes looked at do not end has no known columns.
        cut = (line == "") & (F.col("length") > _HEADER_BYTES)
        found = F.when(~cut, F.decode(F.unhex(whole), name))
        header = F.when(encoding == name, found).otherwise(header)
        ends = F.substring(units, F.length(line) + 1, F.lit(8)) == carriage + newline
        line_end = F.when((encoding == name) & ends, F.lit("\r\n")).otherwise(line_end)
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "checksum",
        encoding.alias("encoding"), header.alias("header"), line_end.alias("line_end"),
    )


def _stream_digests():
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"]):
                where = path if "://" in path else "file://" + path.removeprefix("file:")
                system, inner = fs.FileSystem.from_uri(where)
                digest, head = hashlib.sha256(), b""
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(1 << 20):
                        digest.update(chunk)
                        head = head or chunk[:_HEADER_BYTES]
                rows.append((path, length, digest.hexdigest(), head))
            yield pd.DataFrame(rows, columns=["path", "length", "checksum", "head"])

    return digests


def file_kinds(manifest: DataFrame, role: str) -> list:
    """The distinct (encoding, header, line_end) of a role's files, checked.

    Raises for the wrong encoding, separator or columns, naming a file of each wrong kind.
    """
    kinds = manifest.groupBy("encoding", "header", "line_end").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("files")).collect()
    for kind in kinds:
        if kind["encoding"] in (None, "UTF-8"):
            found = ("a UTF-8 mark; the file was probably re-saved by a spreadsheet"
                     if kind["encoding"] else "no UTF-16 byte-order mark")
            raise SourceFormatError(f"{kind['name']}: expected a UTF-16 export, found {found}")
        if kind["header"] is None:
            raise SourceFormatError(
                f"{kind['name']}: the header line does not end within {_HEADER_BYTES} bytes")
        if "\t" not in kind["header"]:
            raise SourceFormatError(f"{kind['name']}: no TAB in the header")
        missing = set(REQUIRED[role]) - set(_columns(kind["header"]))
        if missing:
            raise SourceSchemaError(
                f"{kind['name']}: not a {role} export, missing {', '.join(sorted(missing))}")
    return kinds


def _columns(header: str) -> list[str]:
    return next(csv.reader([header], delimiter="\t"))


def discover_batches(spark: SparkSession, folder: str) -> DataFrame:
    """``month`` and one path per role for every month with transactions in a folder."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.csv").select("path")
    name = F.element_at(F.split("path", "/"), -1)
    role, month = F.lit(None).cast("string"), F.lit(None).cast("string")
    for known, stem in FILE_NAMES.items():
        pattern = rf"^{stem}-(.+)\.csv$"
        role = F.when(name.rlike(pattern), F.lit(known)).otherwise(role)
        month = F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(month)
    found = files.select("path", role.alias("role"), month.alias("month")).filter(
        F.col("role").isNotNull())
    triples = found.groupBy("month").agg(*[
        F.max(F.when(F.col("role") == r, F.col("path"))).alias(r) for r in FILE_NAMES
    ]).filter(F.col("transactions").isNotNull())
    incomplete = triples.filter(
        F.col("items_detail").isNull() | F.col("items_summary").isNull()).take(5)
    if incomplete:
        raise FileNotFoundError(
            "incomplete batch for " + ", ".join(sorted(r["month"] for r in incomplete)))
    if triples.isEmpty():
        raise FileNotFoundError(f"no exports in {folder}")
    return triples.orderBy("month")


# --- rows ----------------------------------------------------------------------------


def read_export(spark: SparkSession, paths: list[str], role: str,
                manifest: DataFrame | None = None, multiline: bool | None = None) -> DataFrame:
    """The bound columns of a role's files as strings, with each row's place in its file.

    Files with a line break inside quotes are found by a line with an odd number of quotes
    and read one task per file, everything else is split; ``multiline`` says so for all files
    without looking. A bound column a file lacks is empty. Pass a stored ``manifest`` where
    there is one: computing it reads every byte.
    """
    manifest = file_manifest(spark, paths) if manifest is None else manifest
    kinds = file_kinds(manifest, role)
    parts = []
    for kind in kinds:
        wanted = paths
        if len(kinds) > 1:
            same = (F.col("header") == kind["header"]) & (F.col("encoding") == kind["encoding"])
            same = same & (F.col("line_end") == kind["line_end"])
            wanted = [r["path"] for r in manifest.filter(same).select("path").collect()]
        whole = wanted if multiline else []
        if multiline is None:
            broken = _with_broken_lines(spark, wanted, kind)
            whole = [path for path in wanted if _tail(path) in broken]
        split = [path for path in wanted if path not in whole]
        parts += [_scan(spark, own, role, kind, together)
                  for own, together in ((split, False), (whole, True)) if own]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def _tail(path: str) -> str:
    """A path without its scheme; the scan and the caller may spell that differently."""
    return re.sub("^[a-z0-9]+:/*", "", path).lstrip("/")


def _with_broken_lines(spark: SparkSession, paths: list[str], kind) -> set[str]:
    """Files in which a line has an odd number of quotes."""
    lines = spark.read.schema("line string").options(
        header=False, sep="\u0001", quote="", encoding=kind["encoding"],
        lineSep=kind["line_end"]).csv(paths)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    found = lines.filter(quotes % 2 == 1).select(
        F.col("_metadata.file_path").alias("path")).distinct().collect()
    return {_tail(urllib.parse.unquote(row["path"])) for row in found}


def _scan(spark: SparkSession, paths: list[str], role: str, kind, multiline: bool) -> DataFrame:
    columns = _columns(kind["header"])
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    reader = spark.read.schema(schema).options(
        header=True, sep="\t", encoding=kind["encoding"], quote='"', escape='"',
        multiLine=multiline)
    if not multiline:
        reader = reader.option("lineSep", kind["line_end"])
    rows = reader.csv(paths)

    def bound(name: str) -> Column:
        value = F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit("")).alias(name)

    return rows.select(*row_keys(), *[bound(c) for c in BOUND[role]])


def row_keys() -> list[Column]:
    """`ROW_KEYS` of a file scan: file, split, and a number that grows by one within a split.

    They hold only where nothing but the scan lies under the select.
    """
    return [F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_seq")]


def row_number_offsets(rows: DataFrame) -> DataFrame:
    """Where each split's rows start in its file: one small row per split.

    Rows of a split are numbered consecutively by the scan, so a file's row numbers follow
    from the counts of its earlier splits and no file is ordered in one task.
    """
    splits = rows.groupBy("_file", "_split").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1)
    return splits.select("_file", "_split", "_first",
                         F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def with_row_numbers(found: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds ``row_number`` (the header is row 1) to rows that carry the row keys."""
    joined = found.join(offsets, ["_file", "_split"], "left")
    number = F.col("_before") + F.col("_seq") - F.col("_first") + F.lit(2)
    return joined.withColumn("row_number", number.cast("bigint")).drop("_first", "_before")
