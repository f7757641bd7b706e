"""ZIP archives in shared storage, read by ranges: the directory is parsed from the end of the file, stored members are addressed inside it.

Nothing is extracted or copied. The directory is read in chunks, so its size does not matter; ZIP64 records are followed where the
older fields overflow. Members must be stored, not deflated, so that a range of a member is a range of the file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

# fixed values: signatures and record layouts of the ZIP format
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_LAYOUT, _END64_LAYOUT, _ENTRY_LAYOUT = "<4s4H2LH", "<4sQ2H2L4Q", "<4s6H3L5H2L"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_LONGEST_COMMENT = 0xFFFF
CHUNK = 1 << 20


class BadArchive(ValueError):
    """A file whose ZIP structure can't be followed."""


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    header: int  # where its local header begins


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Archive:
    """Directory and ranges of one ZIP file, given as a seekable Arrow file."""

    def __init__(self, file):
        self.file, self.length = file, file.size()

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.length:
            raise BadArchive(f"range {at}+{size} lies outside a file of {self.length} bytes")
        got = self.file.read_at(size, at)
        if len(got) != size:
            raise BadArchive(f"{len(got)} of {size} bytes at {at}")
        return got

    def _directory(self) -> tuple[int, int, int]:
        """Entries, bytes and place of the central directory."""
        size = struct.calcsize(_END_LAYOUT)
        start = max(0, self.length - size - _LONGEST_COMMENT)
        tail = self.read(start, self.length - start)
        at = len(tail)
        while True:  # a comment may contain the signature: the true record's comment ends with the file
            at = tail.rfind(_END, 0, at + 3 if at < len(tail) else at)
            if at < 0:
                raise BadArchive("no end of a central directory")
            if at + size <= len(tail):
                *_, entries, n_bytes, offset, comment = struct.unpack_from(_END_LAYOUT, tail, at)
                if at + size + comment == len(tail):
                    break
        if entries == _FULL16 or n_bytes == _FULL32 or offset == _FULL32:
            place = start + at - 20
            if place >= 0 and (locator := self.read(place, 20))[:4] == _LOCATOR:
                end = self.read(struct.unpack_from("<Q", locator, 8)[0], struct.calcsize(_END64_LAYOUT))
                if end[:4] != _END64:
                    raise BadArchive("the locator does not point to a ZIP64 record")
                *_, entries, n_bytes, offset = struct.unpack(_END64_LAYOUT, end)
        return entries, n_bytes, offset

    def members(self) -> Iterator[Member]:
        """Members in the order of the central directory."""
        entries, left, at = self._directory()
        head, data = struct.calcsize(_ENTRY_LAYOUT), b""

        def need(n: int) -> None:
            nonlocal data, at, left
            if len(data) < n:
                take = min(left, max(CHUNK, n - len(data)))
                data, at, left = data + self.read(at, take), at + take, left - take
            if len(data) < n:
                raise BadArchive("the central directory ends early")

        for _ in range(entries):
            need(head)
            f = struct.unpack_from(_ENTRY_LAYOUT, data)
            flags, method, packed, size, n_name, n_extra, n_comment, header = f[3], f[4], f[8], f[9], f[10], f[11], f[12], f[16]
            if f[0] != _ENTRY:
                raise BadArchive("an entry of the central directory has another signature")
            need(head + n_name + n_extra + n_comment)
            name = data[head : head + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            size, packed, header = _wide(data[head + n_name : head + n_name + n_extra], size, packed, header)
            data = data[head + n_name + n_extra + n_comment :]
            if method or flags & 1:
                if _wanted(name):
                    raise BadArchive(f"{name} is not stored plainly, so it has no ranges")
                continue
            if size != packed:
                raise BadArchive(f"{name} is stored, but its sizes differ")
            yield Member(name, size, header)

    def data_start(self, member: Member) -> int:
        """Where the bytes of a member begin; the local header has lengths of its own."""
        head = self.read(member.header, 30)
        if head[:4] != _LOCAL:
            raise BadArchive(f"no local header for {member.name}")
        n_name, n_extra = struct.unpack_from("<2H", head, 26)
        return member.header + 30 + n_name + n_extra


def _wanted(name: str) -> bool:
    return name.startswith(("archive/", "indexes/")) and not name.endswith("/")


def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """The three numbers, from the ZIP64 field where they overflow; it holds only those that do, in this order."""
    values, at = [size, packed, header], 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            place = at + 4
            for i, v in enumerate(values):
                if v == _FULL32:
                    if place + 8 > at + 4 + n:
                        raise BadArchive("a ZIP64 field is too short")
                    values[i] = struct.unpack_from("<Q", extra, place)[0]
                    place += 8
        at += 4 + n
    return values[0], values[1], values[2]
