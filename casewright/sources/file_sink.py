"""A Python data source that writes named files, or zips of them, all or none.

Rows are ``archive, name, part, content``: the content of one file in one or more parts.  With a null archive it becomes a
file of its own; else it is streamed into that zip, so a task holds one part at a time, however large the session is.
Every task attempt writes into a folder of its own; only when all tasks have ended does the driver move the files of
those that count into place, and after a failure nothing is left.  A file that is there already is an error, unless
the mode is ``overwrite``.

Folders are reached through Arrow's file systems, which local paths and the usual remote stores have.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zipfile
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from casewright.session import short_batches
from casewright.sources.zip_writer import BLOCK, ZipWriter

SCHEMA = "archive string, name string, part int, content binary"
PART = 1 << 22
MOVERS = 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt has written: its folder, and the names in it as one text, which no object a name takes."""

    folder: str
    names: str
    count: int

    def each(self) -> Iterator[str]:
        """The names, one after another."""
        start = 0
        for _ in range(self.count):
            end = self.names.find("\0", start)
            yield self.names[start:end]
            start = end + 1


def _one_name_twice(written: list[Written]) -> bool:
    """Whether two tasks wrote one file.  Names are held by their hashes, and compared where these are equal."""
    hashes = np.concatenate([np.fromiter(map(hash, m.each()), np.int64, m.count) for m in written] or [np.empty(0, np.int64)])
    hashes.sort()
    again = set(hashes[1:][hashes[1:] == hashes[:-1]].tolist())
    seen: set[str] = set()
    for name in (n for m in written if again for n in m.each() if hash(n) in again):
        if name in seen:
            return True
        seen.add(name)
    return False


def _move_all(system: pafs.FileSystem, source: str, target: str, names: list[str]) -> None:
    move = os.rename if isinstance(system, pafs.LocalFileSystem) else system.move  # the same, with less to do for each
    for name in names:
        move(f"{source}/{name}", f"{target}/{name}")


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.token = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str, str]:
        system, base = file_system(self.path)
        return system, base.rstrip("/"), f"{base.rstrip('/')}/_parts/{self.token}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, parts = self._open()
        folder = f"{parts}/{uuid.uuid4().hex}"
        names: dict[str, None] = {}  # in order, and looked up once per file
        made: set[str] = set()
        target = archive = None
        now: tuple | None = None

        def end_target() -> None:
            nonlocal target, archive
            if archive is not None:
                archive.close()
            if target is not None:
                target.close()
            target = archive = None

        def open_target(name: str, buffer: int | None):
            if name in names:
                raise ValueError(f"the rows of {name} are not together")
            names[name] = None
            at = f"{folder}/{name}"
            if (parent := at.rpartition("/")[0]) not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            return system.open_output_stream(at, buffer_size=buffer)

        try:
            for batch in iterator:
                for zipped, name, part, content in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("archive", "name", "part", "content"))):
                    key = zipped.as_py(), name.as_py()
                    if key == now and part.as_py() == 0:
                        raise ValueError(f"{key[1]} is there twice")
                    if key != now:
                        if now is None or key[0] is None or key[0] != now[0]:
                            end_target()
                            target = open_target(key[1], None) if key[0] is None else open_target(key[0], BLOCK)
                            archive = None if key[0] is None else ZipWriter(target)
                        if archive is not None:
                            archive.begin(key[1])
                        now = key
                    (archive or target).write(content.as_buffer() if content.is_valid else b"")
            end_target()
        except BaseException:
            if target is not None:
                target.close()
            raise
        return Written(folder, "".join(f"{n}\0" for n in names), len(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, base, parts = self._open()
        written = [m for m in messages if m]
        folders = sorted({f"{base}/{n}".rpartition("/")[0] for m in written for n in m.each()})
        there = [] if self.overwrite else self._there(system, base, folders, written)
        if there or _one_name_twice(written):
            self.abort(messages)
            raise FileExistsError(f"files are there already: {there[:3]}" if there else "two tasks wrote one file")
        for folder in folders:
            system.create_dir(folder, recursive=True)
        # A rename on a disk takes microseconds; a store that answers slowly gets many moves at once.
        movers = 1 if isinstance(system, pafs.LocalFileSystem) else MOVERS
        with ThreadPoolExecutor(movers) as pool:
            under_way: deque = deque()
            for m in written:
                for names in batched(m.each(), 1024):
                    if len(under_way) == 2 * movers:
                        under_way.popleft().result()
                    under_way.append(pool.submit(_move_all, system, m.folder, base, names))
            for done in under_way:
                done.result()
        self.abort(messages)

    @staticmethod
    def _there(system: pafs.FileSystem, base: str, folders: list[str], written: list[Written]) -> list[str]:
        """Some files that are there already, of one batch; in a folder that is not there none can be."""
        old = {f for f in folders if system.get_file_info(f).type != pafs.FileType.NotFound}
        for m in written if old else []:
            for names in batched((t for n in m.each() if (t := f"{base}/{n}").rpartition("/")[0] in old), 1024):
                if found := [x.path for x in system.get_file_info(list(names)) if x.type != pafs.FileType.NotFound]:
                    return found
        return []

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of this write stays but what was moved into place."""
        system, base, parts = self._open()
        if system.get_file_info(parts).type != pafs.FileType.NotFound:
            system.delete_dir(parts)
        rest = f"{base}/_parts"
        if system.get_file_info(rest).type != pafs.FileType.NotFound and not system.get_file_info(pafs.FileSelector(rest)):
            system.delete_dir(rest)


class FileSink(DataSource):
    """``format("casewright_files")``; the option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "casewright_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def in_parts(files: DataFrame, size: int = PART) -> DataFrame:
    """``files(archive, name, content)`` with contents cut into parts, so that no batch holds a large file."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1))
    cut = files.withColumn("part", part)
    return cut.withColumn("content", F.substring("content", F.col("part") * size + 1, F.lit(size))).select("archive", "name", "part", "content")


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``files(archive, name, content)``; a null archive stands for a file of its own.

    The files of an archive go to one task, in order of their names, and stream through it.  The number of tasks is
    given, since many small files cost by their number and would else be dealt by their bytes, to a task or two.
    """
    whole = F.coalesce("archive", "name")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    write_rows(in_parts(files).repartition(tasks, whole).sortWithinPartitions(whole, "name", "part"), path, mode)


def write_each(files: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``files(name, content)``, every row a file of its own.

    The rows of each task are counted first, which reads no content.  Where none has over one and a half times the share of a core, they
    are written as they are dealt, without a shuffle of all contents; else they are dealt anew by ``write_files``.
    """
    dealt = [r["count"] for r in files.select(F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
    own = files.select(F.lit(None).cast("string").alias("archive"), "name", "content")
    if 2 * max(dealt, default=0) * files.sparkSession.sparkContext.defaultParallelism <= 3 * sum(dealt):
        write_rows(in_parts(own), path, mode)
    else:
        write_files(own, path, mode)


def write_rows(parts: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``parts(archive, name, part, content)`` as they are dealt and ordered; part 0 begins a file."""
    spark: SparkSession = parts.sparkSession
    short_batches(spark)
    spark.dataSource.register(FileSink)
    parts.write.format("casewright_files").mode(mode).option("path", path).save()


_MEMBERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("digest", T.StringType())]))


@F.arrow_udf(_MEMBERS)
def _members(content: pa.Array) -> pa.Array:
    def one(raw: bytes) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [{"name": n, "size": z.getinfo(n).file_size, "digest": hashlib.sha256(z.read(n)).hexdigest()} for n in z.namelist()]

    kind = pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64()), ("digest", pa.string())]))
    return pa.array([None if x is None else one(x) for x in content.to_pylist()], kind)


def zip_members(content: Column) -> Column:
    """Names, sizes and SHA-256 digests of a zip's members, from its bytes."""
    return _members(content)
