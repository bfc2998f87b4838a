"""Members of a ZIP file by its directories, without reading anything else of the file."""

from __future__ import annotations

import struct
from typing import BinaryIO, NamedTuple

_END = struct.Struct("<4s4H2LH")
_END64 = struct.Struct("<4sQ2H2L4Q")
_LOCATOR64 = struct.Struct("<4sLQL")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
_FULL = 0xFFFFFFFF


class Member(NamedTuple):
    """A directory entry; `at` is where its local header begins."""

    name: str
    method: int
    size: int
    packed: int
    at: int


class DamagedArchive(ValueError):
    """The directories of an archive can't be followed."""


def _read(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise DamagedArchive("archive ends inside a structure")
    return data


def _directory(file: BinaryIO, length: int) -> tuple[int, int, int]:
    """(entries, size, place) of the central directory, by the ZIP64 records if there are any."""
    tail_at = max(0, length - _END.size - 0xFFFF)
    tail = _read(file, tail_at, length - tail_at)
    found = tail.rfind(b"PK\5\6")
    while found >= 0:
        if found + _END.size <= len(tail):
            end = _END.unpack_from(tail, found)
            if found + _END.size + end[7] == len(tail):
                break
        found = tail.rfind(b"PK\5\6", 0, found)
    if found < 0:
        raise DamagedArchive("no end of central directory")
    entries, size, place = end[4], end[5], end[6]
    locator_at = tail_at + found - _LOCATOR64.size
    if locator_at >= 0:
        mark, _, end64_at, _ = _LOCATOR64.unpack(_read(file, locator_at, _LOCATOR64.size))
        if mark == b"PK\6\7":
            end64 = _END64.unpack(_read(file, end64_at, _END64.size))
            if end64[0] != b"PK\6\6":
                raise DamagedArchive("no ZIP64 end of central directory where its locator points")
            entries, size, place = end64[7], end64[8], end64[9]
    return entries, size, place


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and places that did not fit, from the ZIP64 part of the extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == _FULL else v for v in values]
        at += 4 + size
    return values


def members(file: BinaryIO, length: int) -> list[Member]:
    """Every member, in directory order."""
    entries, size, place = _directory(file, length)
    data, at, out = _read(file, place, size), 0, []
    for _ in range(entries):
        if at + _ENTRY.size > len(data):
            raise DamagedArchive("central directory is shorter than its count")
        e = _ENTRY.unpack_from(data, at)
        if e[0] != b"PK\1\2":
            raise DamagedArchive("no directory entry where one is due")
        name_size, extra_size, note_size = e[10:13]
        at += _ENTRY.size
        name = data[at: at + name_size].decode("utf-8" if e[3] & 0x800 else "cp437")
        full, packed, begin = _wide(data[at + name_size: at + name_size + extra_size],
                                    [e[9], e[8], e[16]])
        at += name_size + extra_size + note_size
        out.append(Member(name, e[4], full, packed, begin))
    return out


def content_at(file: BinaryIO, member: Member) -> int:
    """Where a member's bytes begin, after its local header."""
    head = _LOCAL.unpack(_read(file, member.at, _LOCAL.size))
    if head[0] != b"PK\3\4":
        raise DamagedArchive(f"no local header of {member.name}")
    return member.at + _LOCAL.size + head[9] + head[10]
