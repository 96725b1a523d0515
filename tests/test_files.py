"""Files and zips written all or none, and the publication built on them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from casewright.operators import publish
from casewright.sources import file_sink


def test_files_and_zips_stream_in_parts(spark, tmp_path):
    big = bytes(range(256)) * 200
    rows = [(None, "a/x.json", b"{}"), ("z/s1.zip", "2.dcm", big), ("z/s1.zip", "1.dcm", b"one"), ("s2.zip", "1.dcm", b""), ("s2.zip", "n", None)]
    df = file_sink.in_parts(spark.createDataFrame(rows, "archive string, name string, content binary"), 1000)
    assert df.where("archive = 'z/s1.zip' AND name = '2.dcm'").count() == -(-len(big) // 1000)
    file_sink.write_files(spark.createDataFrame(rows, "archive string, name string, content binary"), str(tmp_path))
    assert (tmp_path / "a/x.json").read_bytes() == b"{}"
    z = zipfile.ZipFile(tmp_path / "z/s1.zip")
    assert z.namelist() == ["1.dcm", "2.dcm"] and z.read("2.dcm") == big
    assert zipfile.ZipFile(tmp_path / "s2.zip").namelist() == ["1.dcm", "n"]
    assert not (tmp_path / "_parts").exists()
    first = (tmp_path / "z/s1.zip").read_bytes()
    with pytest.raises(Exception, match="there already"):
        file_sink.write_files(spark.createDataFrame(rows, "archive string, name string, content binary"), str(tmp_path))
    file_sink.write_files(spark.createDataFrame(rows[1:3], "archive string, name string, content binary"), str(tmp_path), "overwrite")
    assert (tmp_path / "z/s1.zip").read_bytes() == first and not (tmp_path / "_parts").exists()
    listed = spark.read.format("binaryFile").load(str(tmp_path / "z")).select(F.explode(file_sink.zip_members(F.col("content"))).alias("m")).select("m.*").collect()
    assert [(r.name, r.size) for r in listed] == [("1.dcm", 3), ("2.dcm", len(big))]


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    df = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 5, F.lit(".zip")).alias("archive"), F.col("id").cast("string").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("disk full"))).otherwise(F.lit(b"x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="disk full"):
        file_sink.write_files(df, str(tmp_path))
    assert not list(tmp_path.rglob("*.zip")) and not (tmp_path / "_parts").exists()


def _session(spark, rows):
    names = "subject string, kind string, media string, new_name string, digest string, instance_num string, is_valid boolean, site string, group string, content binary"
    return spark.createDataFrame([(s, k, m, n, d, str(i), v, "site", "grp", c) for i, (s, k, m, n, d, v, c) in enumerate(rows)], names)


FILES = [
    ("s1", "ESV", "DICOM", "0001-s1", "d1", True, b"one"),
    ("s1", "ESV", "DICOM", "0002-s1", "d2", False, b"bad"),
    ("s1", "ESV", "MP4", "000-s1", "v1", True, b"film"),
    ("s2", "RF", "DICOM", "0001-s2", "d3", True, b"two"),
]


def test_publication_commits_zips_and_registry_rows_together(spark, tmp_path):
    root = str(tmp_path)
    name = publish.publish_sessions(_session(spark, FILES), root, "demo", "2_25_1", F.lit("2024-01-01"))
    zips = {r.path.rsplit("/", 1)[1]: zipfile.ZipFile(io.BytesIO(r.content)).namelist() for r in publish.published_zips(spark, root).collect()}
    assert zips == {"s1-dicom.zip": ["0001-s1"], "s1-mp4.zip": ["000-s1"], "s2-dicom.zip": ["0001-s2"]}
    hashes = publish.published(spark, root, "IMAGE_HASHES", publish.HASHES_ROW).collect()
    assert sorted((r.NAME, r.SUBJECT, r.INSTANCE_NUM) for r in hashes) == [("d1", "s1", "0"), ("d3", "s2", "3")] and all(r.UID.startswith("2_25_") for r in hashes)
    assert sorted(r.NAME for r in publish.published(spark, root, "SUBJECTS", publish.SUBJECTS_ROW).collect()) == ["s1", "s2"]
    plan = publish.download_plan(spark, root, spark.createDataFrame([("s1",)], "subject string"), "/out").orderBy("position").collect()
    assert [(r.position, r.target) for r in plan] == [(1, "/out/s1/s1-dicom.zip"), (2, "/out/s1/s1-mp4.zip")]
    assert (tmp_path / "publications" / name / "files/project/demo/subject/s2/experiment/SOURCE_DATA-s2/scan/0/resource/SRC/s2-dicom.zip").exists()


@pytest.mark.parametrize(("rows", "message"), [
    ([("s3", "RF", "DICOM", "a", "d4", False, b"x"), ("s3", "RF", "DICOM", "b", "d5", True, b"x")], "invalid"),
    ([("s3", "ESV", "DICOM", "a", "d4", False, b"x")], "without a valid"),
    ([("s1", "ESV", "DICOM", "a", "d4", True, b"x")], "the subject exists"),
    ([("s3", "ESV", "DICOM", "a", "d4", True, b"x"), ("s3", "ESV", "DICOM", "a", "d5", True, b"y")], "one name"),
])
def test_refused_publications_write_nothing(spark, tmp_path, rows, message):
    root = str(tmp_path)
    publish.publish_sessions(_session(spark, FILES), root, "demo", "2_25_1", F.lit("2024-01-01"))
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    with pytest.raises(ValueError, match=message):
        publish.publish_sessions(_session(spark, rows), root, "demo", "2_25_1", F.lit("2024-01-01"))
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before


def test_a_failing_publication_leaves_neither_zip_nor_registry_row(spark, tmp_path):
    rows = [("s9", "ESV", "DICOM", str(i), f"d{i}", True, b"x") for i in range(20)]
    broken = _session(spark, rows).withColumn("content", F.when(F.col("new_name") == "17", F.raise_error(F.lit("disk full")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="disk full"):
        publish.publish_sessions(broken, str(tmp_path), "demo", "2_25_1", F.lit("2024-01-01"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
