"""Web pages as WARC records in ZIP packages, and records read back by ranges.

A package holds `archive/data.warc.gz` and `indexes/index.jsonl`, both stored, so that a record
is a range of the package itself: every record is a gzip member of its own, and the index has
its place. Reading parses the directories (ZIP64 too), finds the stored members, cuts each
archive into ranges of whole records by the index, and spreads the ranges over tasks.

Tasks write and read packages in a folder that all of them share. A package counts only if its
task has reported it, so an attempt that was lost leaves at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch
from tallyhouse.llm.zipfile_ranges import DamagedArchive, content_at, members
from tallyhouse.session import ship

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"
MIN_SHARED = 100
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 2 << 20
TASK_BYTES = 32 << 20
FEED_BYTES = 1 << 15
_EDGE = b"\r\n\r\n"


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def _field(text: str) -> str:
    """A header value: control characters and white space of a URL as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit of the page `refers_to` with the same headers."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Date: {RECORD_DATE}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _EDGE + block + _EDGE


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of one record."""
    head, edge, rest = data.partition(_EDGE)
    if not edge or not head.startswith(b"WARC/"):
        raise DamagedArchive("not a WARC record")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if rest[size:] != _EDGE:
        raise DamagedArchive("record is cut off or too long")
    return fields, rest[:size]


def _page(text: str | None):
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def _writer(folder: str, package_bytes: int):
    """Writes rows to packages and reports (path, records, bytes)."""
    class Package:
        def __init__(self, store, root: str) -> None:
            self.name = f"{folder}/{uuid.uuid4().hex}.zip"
            self.sink = store.open_output_stream(f"{root}/{self.name.rpartition('/')[2]}")
            self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
            self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
            self.index, self.at, self.count = io.StringIO(), 0, 0

        def add(self, record: bytes, page_id) -> None:
            packed = zlib.compressobj(6, wbits=31)
            data = packed.compress(record) + packed.flush()
            self.member.write(data)
            json.dump({"id": page_id, "offset": self.at, "length": len(data)}, self.index)
            self.index.write("\n")
            self.at, self.count = self.at + len(data), self.count + 1

        def close(self) -> None:
            self.member.close()
            self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
            self.zip.close()
            self.sink.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        package, done = None, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(
                    *(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if package is None:
                    store.create_dir(root, recursive=True)
                    package = Package(store, root)
                body = html.as_buffer()
                payload = b"" if body is None else body.to_pybytes()
                package.add(record_bytes(page_id.as_py(), url.as_py(), payload, digest.as_py(),
                                         refers_to.as_py()), page_id.as_py())
                if package.at >= package_bytes:
                    package.close()
                    done.append((package.name, package.count, package.at))
                    package = None
        if package is not None:
            package.close()
            done.append((package.name, package.count, package.at))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()),
             *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))],
            names=["path", "records", "bytes"])
    return run


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(path, records, bytes) of the packages written for (page_id, url, html); reading it writes.

    Of pages with equal payloads of at least `MIN_SHARED` bytes, the one with the smallest id
    becomes a response and the others revisit it. Null payloads are empty; null ids refer to
    nothing and nothing refers to them.
    """
    ship(pages.sparkSession)
    body = F.coalesce("html", F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast(
        "string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    keys = named.filter((F.octet_length("html") >= MIN_SHARED) & F.col("page_id").isNotNull()) \
        .select("page_id", "digest")
    first = keys.groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter(
        "refers_to < last").drop("last")
    again = keys.join(first, "digest").filter("page_id > refers_to").distinct()
    full = named.join(again, ["page_id", "digest"], "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    return full.mapInArrow(_writer(folder, package_bytes), "path string, records long, bytes long")


def _ranges(range_bytes: int):
    """Stretches of whole records of each package: (path, at, size)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int]] = []
            for path in batch.column("path").to_pylist():
                store, name = _filesystem(path)
                with store.open_input_file(name) as file:
                    found = {m.name: m for m in members(file, file.size())}
                    if RECORDS not in found:
                        raise DamagedArchive(f"{path}: no {RECORDS}")
                    for m in (found[n] for n in (RECORDS, INDEX) if n in found):
                        if m.method != 0:
                            raise DamagedArchive(f"{path}: {m.name} is not stored")
                    records = found[RECORDS]
                    begin = content_at(file, records)
                    ends = [records.size]
                    if INDEX in found:
                        file.seek(content_at(file, found[INDEX]))
                        entries = map(json.loads, file.read(found[INDEX].size).splitlines())
                        ends = [e["offset"] + e["length"] for e in entries]
                    at = 0
                    for i, end in enumerate(ends):
                        if end - at >= range_bytes or i == len(ends) - 1:
                            if end > at:
                                rows.append((path, begin + at, end - at))
                            at = end
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.string(), pa.int64(), pa.int64()))], names=["path", "at", "size"])
    return run


def _unpacked(data: bytes, begin: int, path: str) -> tuple[bytes, int]:
    """(record, place after it) of the gzip member that begins at a place, fed in short steps so
    that what follows it is not copied."""
    unpack, out = zlib.decompressobj(wbits=31), []
    while not unpack.eof:
        step = data[begin: begin + FEED_BYTES]
        if not step:
            raise DamagedArchive(f"{path}: record is cut off")
        out.append(unpack.decompress(step))
        begin += len(step) - len(unpack.unused_data)
    return b"".join(out), begin


def read_tasks(packages: DataFrame) -> int:
    """Tasks that read packages: one for about `TASK_BYTES`, and no fewer than shuffles have."""
    size = F.sum("bytes") if "bytes" in packages.columns else F.count("*") * PACKAGE_BYTES
    usual = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-(packages.agg(size).first()[0] or 0) // TASK_BYTES))


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size"))):
                store, name = _filesystem(path)
                with store.open_input_file(name) as file:
                    data = file.read_at(size, at)
                out: list[tuple] = []
                begin = 0
                while begin < len(data):
                    record, begin = _unpacked(data, begin, path)
                    fields, block = parse_record(record)
                    head, _, payload = block.partition(_EDGE)
                    kind = fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    if kind == "response" and (
                            len(payload) != length
                            or hashlib.sha256(payload).hexdigest() != digest):
                        raise DamagedArchive(f"{path}: payload differs from its digest")
                    row = (_page(fields["warc-record-id"]), length, digest, kind,
                           _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"))
                    out.append((*row, payload) if with_payload else row)
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                         "url", "payload"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(),
                         pa.binary()]
                width = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], kinds[i]) for i in range(width)],
                    names=names[:width])
    return run


def read_packages(packages: DataFrame, with_payload: bool = False,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per record of the packages named in `path`: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, and with `with_payload` the payload (empty for revisits).

    Directories and indexes are read first, then ranges of about `range_bytes` of whole
    records. Payloads are held against their digests; a damaged package raises. Range rows are
    tiny, so they are dealt to a number of tasks that follows the bytes of the packages (column
    `bytes`; taken as `PACKAGE_BYTES` each where it is missing), which adaptive execution keeps.
    """
    ship(packages.sparkSession)
    tasks = read_tasks(packages)
    ranges = packages.select("path").mapInArrow(
        _ranges(range_bytes), "path string, at long, size long")
    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string,"
              " refers_to long, url string" + ", payload binary" * with_payload)
    return ranges.repartition(tasks, "path", "at").mapInArrow(_reader(with_payload), schema)


def archived(pages: DataFrame) -> DataFrame:
    """The pages written to packages in the shared folder and read back, one row per page.

    Takes page_id, url and html; null, empty and very long payloads, null URLs, null ids and
    repeated rows give a record each. Repeated rows of the smallest id are all responses.
    """
    scratch = Scratch(pages.sparkSession, "web-archive")
    written = scratch.put("manifest", write_packages(pages, f"{scratch.root}/packages"))
    return read_packages(written)
