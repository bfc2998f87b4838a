"""Packages: round trips, directories beside Python's zipfile, damage."""

import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.errors import PythonException

from tallyhouse.llm import web_archive
from tallyhouse.llm.web_archive import archived, read_packages, write_packages
from tallyhouse.llm.zipfile_ranges import DamagedArchive, content_at, members

PAGES = [(1, "http://a/ b\n", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""),
         (5, "u", "y" * 99), (6, "u", "y" * 99), (7, "u", "é" * 50), (8, "v", "é" * 50),
         (9, "u", "\r\n\r\nWARC/1.1\r\n" * 9), (None, "n", "x" * 200), (1, "http://a/ b\n", "x" * 200),
         (10, "u", "z" * 300_000)]


def expected():
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        of = first.get(h)
        again = i is not None and of is not None and i > of
        out.append((i, len(data), hashlib.sha256(data).hexdigest(),
                    "revisit" if again else "response", of if again else None))
    return sorted(out, key=str)


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr(
        "*", "1 as digest", "2 as refers_to").repartition(3)


def test_round_trip(spark):
    got = archived(pages(spark)).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected()
    assert archived(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("range_bytes", [1, 1 << 20])
def test_payloads_and_small_packages(spark, tmp_path, range_bytes):
    listed = write_packages(pages(spark), f"file://{tmp_path}", package_bytes=200)
    found = listed.collect()
    assert sum(r["records"] for r in found) == len(PAGES) and len(found) > 3
    frame = spark.createDataFrame(found)
    got = read_packages(frame, True, range_bytes).collect()
    texts = {i: (h or "").encode() for i, _, h in PAGES}
    assert len(got) == len(PAGES)
    for r in got:
        assert bytes(r["payload"]) == (texts[r["page_id"]] if r["record_type"] == "response" else b"")
    assert {r["url"] for r in got if r["page_id"] == 1} == {"http://a/%20b%0A"}
    assert {r["url"] for r in got if r["page_id"] == 2} == {None}


def test_directories_agree_with_zipfile():
    for wide in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in (("a", b"1" * 50), ("dir/é", b"22"), ("e", b"")):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as m:
                    m.write(data)
            z.comment = b"a note at the end"
        data = out.getvalue()
        found = members(io.BytesIO(data), len(data))
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert [(m.name, m.size) for m in found] == [(i.filename, i.file_size) for i in z.infolist()]
            for m in found:
                at = content_at(io.BytesIO(data), m)
                assert data[at: at + m.size] == z.read(m.name)


def test_zip64_directory():
    """An entry and an end record whose values lie in the ZIP64 parts."""
    local = struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0, 0, 0, 0, 0, 5, 5, 1, 0) + b"a" + b"hello"
    extra = struct.pack("<2H3Q", 1, 24, 5, 5, 0)
    entry = struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1,
                        len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    at = len(local)
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sLQL", b"PK\6\7", 0, at + len(entry), 1)
    end = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + entry + end64 + locator + end
    (m,) = members(io.BytesIO(data), len(data))
    assert (m.name, m.size, m.at) == ("a", 5, 0)
    at = content_at(io.BytesIO(data), m)
    assert data[at: at + 5] == b"hello"


def test_damage_is_an_error(spark, tmp_path):
    with pytest.raises(DamagedArchive):
        members(io.BytesIO(b"nothing"), 7)
    found = write_packages(pages(spark).coalesce(1), f"file://{tmp_path}").collect()
    path = found[0]["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[len(web_archive.RECORDS) + 300] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(PythonException):
        read_packages(spark.createDataFrame(found)).collect()


def test_reading_is_dealt_to_tasks_by_bytes(spark):
    sized = [("a", 1, 10 * web_archive.TASK_BYTES), ("b", 1, web_archive.TASK_BYTES + 1)]
    packages = spark.createDataFrame(sized, "path string, records long, bytes long")
    assert web_archive.read_tasks(packages) == 12
    assert web_archive.read_tasks(packages.select("path")) == 4  # two packages of 64 MB
    assert web_archive.read_tasks(packages.limit(0)) == 4
    plan = read_packages(packages)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 12)" in plan
