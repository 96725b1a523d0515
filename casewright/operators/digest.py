"""The digests of ordered texts that no task holds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.sources.file_sink import file_system

READ = 1 << 20


@F.arrow_udf(T.StringType())
def _file_digest(folders: pa.Array, cut: pa.Array) -> pa.Array:
    def one(folder: str, cut: int) -> str:
        system, base = file_system(folder)
        parts = sorted(x.path for x in system.get_file_info(pafs.FileSelector(base)) if x.is_file and x.base_name.startswith("part-"))
        digest, held = hashlib.sha256(), b""
        for path in parts:
            with system.open_input_stream(path) as f:
                while block := f.read(READ):
                    held += block
                    digest.update(held[:-cut])
                    held = held[-cut:]
        return digest.hexdigest()  # what is held is the last separator

    return pa.array([one(f, c) for f, c in zip(folders.to_pylist(), cut.to_pylist())], pa.string())


def ordered_digest(lines: DataFrame, line: Column, *order: str, separator: str, folder: str) -> DataFrame:
    """``n, digest``: how many rows, and the SHA-256 of their texts in ``order`` with the separator between them.

    The texts are sorted over ranges and written to ``folder`` (which must not be there), then read once as a stream: a
    digest follows its text, but a megabyte of it is all that stands in memory.  Null texts are empty.
    """
    spark = lines.sparkSession
    own = lines.select(*order, F.coalesce(line, F.lit("")).alias("#line"))
    own.orderBy(*order, "#line").select("#line").write.option("lineSep", separator).text(folder)
    digest = spark.range(1).select(_file_digest(F.lit(folder), F.lit(len(separator.encode()))).alias("digest"))
    return lines.agg(F.count("*").alias("n")).crossJoin(digest)


def grouped_digests(lines: DataFrame, key: str, line: Column, *order: str, separator: str) -> DataFrame:
    """``key, n, digest`` of every group: how many rows, and the SHA-256 of their texts in ``order`` with the separator
    between them.

    A group's rows go to one task, sorted, and pass its digest one batch after another.  Null texts are empty.
    """
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lines.select(F.col(key).cast("string").alias(key), *order, F.coalesce(line, F.lit("")).alias("#line")).repartition(tasks, key).sortWithinPartitions(key, *order, "#line")
    between = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, digest = None, 0, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["key", "n", "digest"])

        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if n and name != group:
                    yield done()
                    n, digest = 0, hashlib.sha256()
                digest.update(between + text.encode() if n else text.encode())
                group, n = name, n + 1
        if n:
            yield done()

    return own.select(key, "#line").mapInArrow(run, "key string, n bigint, digest string").withColumnRenamed("key", key)
