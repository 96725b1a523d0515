"""Headers are Python objects a few rows at a time, whatever the batch, and batches of files are short."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from casewright.sources import dicom, file_sink


def batch(n):
    tags = [[("00080050", {"vr": "SH", "value": str(i)})] + [(f"0040A730[{k}].0040A160", {"vr": "UT", "value": f"{i} {k}"}) for k in range(20)] for i in range(n)]
    flag = lambda value: pa.array([value] * n)
    kind = pa.map_(pa.string(), pa.struct([("vr", pa.string()), ("value", pa.string())]))
    return pa.array(tags, kind), flag(1), flag(2), flag(b"\1\2"), flag(True), flag(False)


def peak(work, *columns):
    tracemalloc.start()
    try:
        return work(*columns), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_does_not_grow_with_the_batch():
    few, many = batch(200), batch(2000)
    (_, small), (files, large) = peak(dicom._encoded.func, *few), peak(dicom._encoded.func, *many)
    assert large < 2 * small and len(files) == 2000
    (_, small), (read, large) = peak(dicom._parsed.func, files.slice(0, 200)), peak(dicom._parsed.func, files)
    assert large < 2 * small
    back = [dict(r["tags"])["00080050"]["value"] for r in read.to_pylist()]
    assert back == [str(i) for i in range(2000)]
    assert len(dicom._encoded.func(*batch(0))) == 0 and len(dicom._parsed.func(pa.array([], pa.binary()))) == 0
    again = dicom._rewritten.func(files, pa.array([r["tags"] for r in read.to_pylist()], many[0].type))
    assert again.equals(files)


def test_files_are_written_in_short_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        files = spark.range(3).select(F.lit(None).cast("string").alias("archive"), F.col("id").cast("string").alias("name"), F.lit(b"x").alias("content"))
        file_sink.write_files(files, str(tmp_path))
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
