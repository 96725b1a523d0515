"""Listings whose driver holds no file, and moves that hold no object for each."""

import os

import pytest
from pyspark.sql import functions as F

from casewright.sources import file_heads, file_sink, listings


def test_listings_are_made_by_tasks_with_the_paths_and_times_of_spark(spark, tmp_path):
    for name in ("a.dcm", "b.DCM", "sub/c", "sub/in/d e%.jpg", "f.MP4", "_parts/x.dcm", ".hidden.jpg", "_success.mp4", "_k=1/g.dcm"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    folder, columns = str(tmp_path), ("path", "modificationTime", "length")
    found = listings._listed(spark, folder)
    assert "binaryFile" not in found._jdf.queryExecution().toString()  # it lists in the driver
    assert sorted(found.collect()) == sorted(listings._files(spark, folder).select(*columns).collect()) and found.count() == 6
    assert sorted(listings._listed(spark, f"{folder}/su*").collect()) == sorted(listings._files(spark, f"{folder}/su*").select(*columns).collect())
    (tmp_path / "empty.dcm").touch()
    assert [r.length for r in listings.dicom_files(spark, folder).where(F.col("path").endswith("empty.dcm")).collect()] == [0]


def test_a_large_folder_is_shared_and_small_ones_go_together(tmp_path, monkeypatch):
    monkeypatch.setattr(file_heads, "PER_TASK", 10)
    monkeypatch.setattr(file_heads, "BATCH", 7)
    names = [f"big/{i}.dcm" for i in range(95)] + [f"s{i}/{j}.dcm" for i in range(9) for j in range(2)] + ["top.dcm", "no.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    reader = file_heads.HeadReader({"path": str(tmp_path), "suffix": ".dcm,.x", "bytes": "3", "tasks": "1000"})
    tasks = reader.partitions()
    assert sum(len(t.folders) == 1 and t.folders[0][2] == 10 for t in tasks) == 10 and len(tasks) <= 13
    rows = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert sorted(r["name"] for r in rows) == sorted(n for n in names if n != "no.txt")
    assert all(r["head"] == r["name"].encode()[:3] and r["length"] == len(r["name"]) for r in rows)
    few = file_heads.HeadReader({"path": str(tmp_path), "suffix": "", "bytes": "0", "tasks": "2"}).partitions()
    assert len(few) <= 4


def test_what_a_task_has_written_is_one_text_and_names_that_two_wrote_are_found(tmp_path, monkeypatch):
    writer = file_sink.FileWriter(str(tmp_path), False)
    written = [file_sink.Written("a", "x\0é/y\0", 2), file_sink.Written("b", "z\0", 1)]
    assert [list(m.each()) for m in written] == [["x", "é/y"], ["z"]]
    monkeypatch.setattr(file_sink, "hash", lambda name: 7, raising=False)
    assert not file_sink._one_name_twice(written) and not file_sink._one_name_twice([])
    twice = [*written, file_sink.Written("c", "é/y\0", 1)]
    assert file_sink._one_name_twice(twice)
    with pytest.raises(FileExistsError, match="two tasks"):
        writer.commit(twice)
    assert not os.listdir(tmp_path)


def test_rows_dealt_evenly_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    dealt_anew = []
    monkeypatch.setattr(file_sink, "write_files", lambda files, path, mode, f=file_sink.write_files: (dealt_anew.append(path), f(files, path, mode)))
    key = F.col("id").cast("string")
    for tasks in (4, 1):
        folder = tmp_path / str(tasks)
        file_sink.write_each(spark.range(0, 60, 1, tasks).select(F.concat(F.lit("a/"), key).alias("name"), key.cast("binary").alias("content")), str(folder))
        assert {x.name: x.read_text() for x in (folder / "a").iterdir()} == {str(i): str(i) for i in range(60)}
    assert dealt_anew == [str(tmp_path / "1")]
    with pytest.raises(Exception, match="two tasks"):
        file_sink.write_each(spark.range(0, 60, 1, 4).select(F.lit("same").alias("name"), key.cast("binary").alias("content")).where("id % 15 = 3"), str(tmp_path / "same"))
    assert not list(tmp_path.rglob("same/*"))
