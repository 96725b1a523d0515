"""Zips written and read without holding their members or an object for each, and digests of groups."""

import hashlib
import io
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.operators import publish
from casewright.operators.digest import grouped_digests
from casewright.sources import zip_members, zip_writer

FILES = [("a", b"one"), ("dir/b", b""), ("é.dcm", bytes(range(256)) * 3), ("last", b"x" * 50)]


class Sink:
    """A stream that cannot seek."""

    def __init__(self, keep=True):
        self.parts, self.keep, self.at = [], keep, 0

    def write(self, data):
        self.at += len(data)
        if self.keep:
            self.parts.append(bytes(data))
        return len(data)

    def flush(self):
        pass


def _written(files):
    sink = Sink()
    z = zip_writer.ZipWriter(sink)
    for name, content in files:
        z.begin(name)
        for i in range(0, len(content), 100):
            z.write(content[i : i + 100])
    z.close()
    return b"".join(sink.parts)


@pytest.mark.parametrize("large", [False, True])
def test_the_bytes_are_those_of_zipfile(monkeypatch, large):
    if large:  # as if members, offsets and numbers were over the limits of small zips
        for module, limit, count in ((zip_writer, "_LIMIT", "_COUNT"), (zipfile, "ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT")):
            monkeypatch.setattr(module, limit, 200)
            monkeypatch.setattr(module, count, 3)
    sink = Sink()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in FILES:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                member.write(content)
    raw = _written(FILES)
    assert raw == b"".join(sink.parts)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == FILES
    assert _read(raw) == FILES
    empty = _written([])
    assert zipfile.ZipFile(io.BytesIO(empty)).namelist() == [] == _read(empty)


def _read(raw):
    f = pa.BufferReader(raw)
    return [(m.name, b"".join(zip_members._content(f, m))) for m in zip_members._members(f, *zip_members._directory(f, len(raw)))]


def test_packed_zips_are_read_in_blocks_and_broken_ones_are_errors(monkeypatch):
    monkeypatch.setattr(zip_members, "BLOCK", 64)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in FILES + [("long", b"ab" * 5000)]:
            z.writestr(name, content)
        z.comment = b"a comment"
    raw = out.getvalue()
    assert _read(raw) == FILES + [("long", b"ab" * 5000)] and _read(_written(FILES)) == FILES
    stored = _written([("a", b"content")])
    for broken in (stored.replace(b"content", b"contend"), b"no zip", b""):
        with pytest.raises(zipfile.BadZipFile):
            _read(broken)


def test_the_writer_holds_no_object_for_a_member():
    z = zip_writer.ZipWriter(Sink(keep=False))
    tracemalloc.start()
    for i in range(60_000):
        z.begin(f"{i:060}")
        z.write(b"x")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    z.close()
    assert peak < 3 * zip_writer.HELD  # lists and objects of zipfile take some 30 MB


def test_members_of_large_zips_are_dealt_in_ranges(spark, tmp_path):
    files = [(f"{i:05}", str(i).encode()) for i in range(zip_members.RANGE_MEMBERS + 500)]
    for name, held in (("a.zip", files), ("b.zip", FILES), ("none.zip", [])):
        (tmp_path / name).write_bytes(_written(held))
    zips = spark.createDataFrame([(str(p), p.stat().st_size) for p in tmp_path.iterdir()], "path string, length long")
    assert zips.mapInArrow(zip_members._ranges, "path string, first bigint, start bigint, stop bigint").count() == 3
    rows = {(r.path[-5:], r.position): (r.name, r.size, r.digest) for r in zip_members.members(zips).collect()}
    assert rows == {(z, i): (n, len(c), hashlib.sha256(c).hexdigest()) for z, held in (("a.zip", files), ("b.zip", FILES)) for i, (n, c) in enumerate(held)}


def test_published_members_are_no_rows_of_whole_zips(spark, tmp_path):
    names = "subject string, kind string, media string, new_name string, digest string, instance_num string, is_valid boolean, site string, group string, content binary"
    rows = [("s", "ESV", m, n, f"{m}{n}", "1", True, "x", "y", n.encode()) for m in ("DICOM", "MP4") for n in ("two", "one")]
    publish.publish_sessions(spark.createDataFrame(rows, names), str(tmp_path), "demo", "2_25_1", F.lit("2024-01-01"))
    found = publish.published_members(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    whole = publish.published_zips(spark, str(tmp_path)).select("path").collect()
    got = sorted((r.path, r.position, r.name, r.digest) for r in found.collect())
    assert got == sorted((w.path, i, n, hashlib.sha256(n.encode()).hexdigest()) for w in whole for i, n in enumerate(("one", "two"))) and len(whole) == 2


def test_digests_of_groups_follow_their_order(spark):
    rows = [("a", i, f"é{i}") for i in range(12_000)] + [("b", 1, None), ("b", 0, "x"), (None, 3, "y")]
    got = {r.k: (r.n, r.d) for r in grouped_digests(spark.createDataFrame(rows, "k string, i int, t string").repartition(5), "k", F.col("t"), "i", separator="|").withColumnRenamed("digest", "d").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {"a": (12_000, sha("|".join(f"é{i}" for i in range(12_000)))), "b": (2, sha("x|")), None: (1, sha("y"))}
