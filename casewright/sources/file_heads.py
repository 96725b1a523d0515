"""A Python data source that lists files in the tasks and reads their first bytes, whatever their size.

The driver walks the folders and keeps the number of their files, not the files: a task is given some folders, or one
share of a large folder, whose files are dealt by a checksum of their names.  Names that begin with ``_`` or ``.`` are
left out, as Spark's own sources do; empty files are listed.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from casewright.sources.file_sink import file_system

SCHEMA = "name string, modified bigint, length bigint, head binary"
PER_TASK = 4096
BATCH = 4096


@dataclass
class Shares(InputPartition):
    """Folders below the listed one, each with which of how many shares of its files is meant."""

    folders: list[tuple[str, int, int]]


def _hidden(name: str) -> bool:
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, pafs.FileInfo | os.DirEntry]]:
    """Name, whether it is a folder, and what the length and time are asked of; on a disk these are not asked yet."""
    if isinstance(system, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((x.name, x.is_dir(), x) for x in found if not _hidden(x.name))
    else:
        found = system.get_file_info(pafs.FileSelector(folder))
        yield from ((x.base_name, x.type == pafs.FileType.Directory, x) for x in found if not _hidden(x.base_name))


def _length_and_time(entry: pafs.FileInfo | os.DirEntry) -> tuple[int, int] | None:
    """Bytes, and milliseconds of the last change; none for a file that has gone."""
    if isinstance(entry, pafs.FileInfo):
        return entry.size, (entry.mtime_ns or 0) // 1_000_000
    try:
        stat = entry.stat()
    except FileNotFoundError:
        return None
    return stat.st_size, stat.st_mtime_ns // 1_000_000


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.tasks = options["path"], int(options.get("bytes", "12")), int(options.get("tasks", "32"))
        self.suffixes = tuple(x for x in options.get("suffix", "").lower().split(",") if x)

    def _wanted(self, name: str) -> bool:
        return not self.suffixes or name.lower().endswith(self.suffixes)

    def partitions(self) -> list[Shares]:
        system, base = file_system(self.path)
        counts, open_ = [], [""]
        while open_:
            folder, n = open_.pop(), 0
            for name, inner, _ in _entries(system, f"{base}/{folder}"):
                if inner:
                    open_.append(f"{folder}{name}/")
                elif self._wanted(name):
                    n += 1
            counts.append((folder, n))
        most = max(PER_TASK, -(-sum(n for _, n in counts) // self.tasks))
        tasks, held, rows = [], [], 0
        for folder, n in sorted(counts):
            if n > most:
                shares = -(-n // most)
                tasks += [Shares([(folder, i, shares)]) for i in range(shares)]
            elif n:
                if held and rows + n > most:
                    tasks.append(Shares(held))
                    held, rows = [], 0
                held, rows = [*held, (folder, 0, 1)], rows + n
        return [*tasks, Shares(held)]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        system, base = file_system(self.path)
        kinds = {"name": pa.string(), "modified": pa.int64(), "length": pa.int64(), "head": pa.binary()}
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds.values())], list(kinds))
            rows.clear()
            return done

        for folder, share, shares in partition.folders:
            for name, inner, entry in _entries(system, f"{base}/{folder}"):
                if inner or not self._wanted(name) or shares > 1 and zlib.crc32(os.fsencode(name)) % shares != share:
                    continue
                if (about := _length_and_time(entry)) is None:
                    continue
                head = b""
                if self.size and about[0]:
                    with system.open_input_file(f"{base}/{folder}{name}") as f:
                        head = f.read_at(min(self.size, about[0]), 0)
                rows.append(((folder + name).encode(errors="replace").decode(), about[1], about[0], head))
                if len(rows) == BATCH:
                    yield batch()
        if rows:
            yield batch()


class FileHeads(DataSource):
    """``format("casewright_heads")`` with the options ``path``, ``suffix`` (some, between commas; case does not count),
    ``bytes`` (none: files are not opened) and ``tasks``, about how many share large folders."""

    @classmethod
    def name(cls) -> str:
        return "casewright_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def _found(spark: SparkSession, folder: str, suffix: str, size: int) -> DataFrame:
    spark.dataSource.register(FileHeads)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("casewright_heads").option("suffix", suffix).option("bytes", str(size)).option("tasks", str(tasks)).load(folder)


def file_heads(spark: SparkSession, folder: str, suffix: str = "", size: int = 12) -> DataFrame:
    """``path, length, head`` of every file below ``folder`` whose name ends so."""
    base = file_system(folder)[1].rstrip("/")
    return _found(spark, folder, suffix, size).select(F.concat(F.lit(f"{base}/"), "name").alias("path"), "length", "head")


def listed(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """``path, modificationTime, length`` of every file below ``folder`` whose name ends so, with paths as Spark spells
    them; no file is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return _found(spark, folder, suffix, 0).select(F.concat(F.lit(f"{base}/"), "name").alias("path"), F.timestamp_millis("modified").alias("modificationTime"), "length")


def is_folder(path: str) -> bool:
    """Whether Arrow reaches ``path`` and finds one folder there, not a file or a pattern."""
    try:
        system, base = file_system(path)
        return system.get_file_info(base).type == pafs.FileType.Directory
    except (pa.ArrowInvalid, OSError):
        return False
