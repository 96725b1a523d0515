"""Zips written as streams: neither a member nor an object for every member is held.

The bytes are those that ``zipfile`` gives for a stream that cannot seek, but the directory is kept as bytes, beyond some
megabytes in a temporary file.
"""

from __future__ import annotations

import struct
import tempfile
import zipfile
import zlib

BLOCK, HELD = 1 << 20, 1 << 22
UTF, _DESCRIPTOR, _DAY, _RIGHTS = 0x800, 0x08, 33, 0o600 << 16  # the day is the first of January 1980
FULL, _LIMIT, _COUNT = 0xFFFFFFFF, zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT


class ZipWriter:
    """Stored members, one after another, dated alike, so that equal input gives equal bytes."""

    def __init__(self, target) -> None:
        self.target, self.at, self.count = target, 0, 0
        self.directory = tempfile.SpooledTemporaryFile(HELD)
        self.name: bytes | None = None

    def _put(self, data) -> None:
        self.target.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.end()
        self.name, self.flags = (name.encode(), _DESCRIPTOR) if name.isascii() else (name.encode(), _DESCRIPTOR | UTF)
        self.began, self.crc, self.size = self.at, 0, 0
        self._put(struct.pack("<4s5H3L2H", b"PK\3\4", 45, self.flags, 0, 0, _DAY, 0, FULL, FULL, len(self.name), 20) + self.name + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data) -> None:
        data = memoryview(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        """The end of a member, if one has begun."""
        if self.name is None:
            return
        self._put(struct.pack("<4sL2Q", b"PK\7\x08", self.crc, self.size, self.size))
        large = [self.size] * 2 * (self.size > _LIMIT) + [self.began] * (self.began > _LIMIT)
        extra = struct.pack(f"<2H{len(large)}Q", 1, 8 * len(large), *large) if large else b""
        size, began = FULL if self.size > _LIMIT else self.size, FULL if self.began > _LIMIT else self.began
        self.directory.write(struct.pack("<4s4B4H3L5H2L", b"PK\1\2", 45, 3, 45, 0, self.flags, 0, 0, _DAY, self.crc, size, size, len(self.name), len(extra), 0, 0, 0, _RIGHTS, began) + self.name + extra)
        self.count, self.name = self.count + 1, None

    def close(self) -> None:
        """Writes the directory; the target stays open."""
        self.end()
        start = self.at
        self.directory.seek(0)
        while block := self.directory.read(BLOCK):
            self._put(block)
        self.directory.close()
        count, size, end = self.count, self.at - start, self.at
        if count > _COUNT or start > _LIMIT or size > _LIMIT:
            self._put(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
            count, size, start = min(count, 0xFFFF), min(size, FULL), min(start, FULL)
        self._put(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, count, count, size, start, 0))
