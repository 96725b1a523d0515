"""The members of zips, read as streams in ranges of their directories, which go to different tasks."""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.sources.file_sink import file_system
from casewright.sources.zip_writer import BLOCK, FULL, UTF

RANGE_BYTES, RANGE_MEMBERS = 1 << 25, 4096
_ENCRYPTED = 0x01


class Member(NamedTuple):
    """An entry of the directory, and where the next one begins."""

    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    start: int
    next: int


def _directory(f, length: int) -> tuple[int, int]:
    """Where the directory begins and ends."""
    from_ = max(0, length - 65557)
    tail = f.read_at(length - from_, from_)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) < at + 22:
        raise zipfile.BadZipFile("the file is not a zip")
    size, start = struct.unpack_from("<2L", tail, at + 12)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        size, start = struct.unpack_from("<2Q", f.read_at(56, struct.unpack_from("<Q", tail, at - 12)[0]), 40)
    return start, start + size


def _members(f, start: int, stop: int) -> Iterator[Member]:
    """The entries between two bytes of the directory, read in blocks."""
    raw, at, base = b"", 0, start
    while base + at < stop:
        need = 46 if len(raw) < at + 46 else 46 + sum(struct.unpack_from("<3H", raw, at + 28))
        if len(raw) < at + need:
            base, raw, at = base + at, f.read_at(min(stop - base - at, max(BLOCK, need)), base + at), 0
            if len(raw) < need:
                raise zipfile.BadZipFile("the directory is cut off")
            continue
        sign, flags, method, crc, packed, size, n, m, k, began = struct.unpack_from("<4s4x2H4x3L3H8xL", raw, at)
        if sign != b"PK\1\2":
            raise zipfile.BadZipFile("no entry of a directory")
        extra, large = raw[at + 46 + n : at + 46 + n + m], [size, packed, began]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<2H", extra)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                large = [next(values) if x == FULL else x for x in large]
            extra = extra[4 + width :]
        at += need
        name = raw[at - k - m - n : at - k - m].decode("utf-8" if flags & UTF else "cp437")
        yield Member(name, flags, method, crc, large[1], large[0], large[2], base + at)


def _content(f, m: Member) -> Iterator[bytes]:
    """The content of a member in blocks, checked against its size and checksum."""
    if m.flags & _ENCRYPTED or m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise zipfile.BadZipFile(f"{m.name} is encrypted or packed in another way")
    head = f.read_at(30, m.start)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile(f"{m.name} does not begin")
    at = m.start + 30 + sum(struct.unpack_from("<2H", head, 26))
    stop, crc, size = at + m.packed, 0, 0
    unpack = zlib.decompressobj(-15) if m.method else None
    while at < stop:
        block = f.read_at(min(BLOCK, stop - at), at)
        if not block:
            break
        at += len(block)
        while block:
            data = unpack.decompress(block, BLOCK) if unpack else block
            block = unpack.unconsumed_tail if unpack else b""
            crc, size = zlib.crc32(data, crc), size + len(data)
            yield data
    while unpack and (data := unpack.decompress(unpack.unconsumed_tail, BLOCK)):
        crc, size = zlib.crc32(data, crc), size + len(data)
        yield data
    if (crc, size) != (m.crc, m.size):
        raise zipfile.BadZipFile(f"{m.name} is broken")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, inner = file_system(path)
            rows = []
            with system.open_input_file(inner) as f:
                start, stop = _directory(f, length)
                first = n = size = 0
                for m in _members(f, start, stop):
                    n, size = n + 1, size + m.size
                    if n == RANGE_MEMBERS or size >= RANGE_BYTES or m.next >= stop:
                        rows.append((path, first, start, m.next))
                        first, start, n, size = first + n, m.next, 0, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "first", "start", "stop"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            system, inner = file_system(path)
            rows = []
            with system.open_input_file(inner) as f:
                for position, m in enumerate(_members(f, start, stop), first):
                    digest = hashlib.sha256()
                    for block in _content(f, m):
                        digest.update(block)
                    rows.append((path, position, m.name, m.size, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "position", "name", "size", "digest"])


def members(zips: DataFrame) -> DataFrame:
    """``path, position, name, size, digest`` of the members of ``zips(path, length)``, with SHA-256 digests.

    Every directory is walked once and cut into ranges; zips, and then ranges, are dealt over a few tasks a core.  A task
    holds a block of a member and the rows of a range.  A member that does not have its checksum is an error.
    """
    tasks = 4 * zips.sparkSession.sparkContext.defaultParallelism
    ranges = zips.select("path", F.col("length").cast("bigint")).repartition(tasks).mapInArrow(_ranges, "path string, first bigint, start bigint, stop bigint")
    return ranges.repartition(tasks).mapInArrow(_digests, "path string, position bigint, name string, size bigint, digest string")
