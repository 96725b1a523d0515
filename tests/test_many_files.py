"""Listings and writes of many small files cost by their number, not by a task or a search for each."""

from pyspark.sql import functions as F

from casewright.sources import file_sink, listings


def test_a_listing_takes_a_few_tasks_a_core(spark, tmp_path):
    most = 4 * spark.sparkContext.defaultParallelism
    for i in range(most + 30):
        (tmp_path / f"{i}.dcm").write_bytes(b"x")
        (tmp_path / f"{i}.mp4").write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for every file, else
    try:
        files = listings.dicom_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= most and files.count() == most + 30
        assert listings.media_files(spark, str(tmp_path)).count() == most + 30
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_thousands_of_files_move_into_place(spark, tmp_path):
    files = spark.range(3000).select(F.lit(None).cast("string").alias("archive"), F.concat(F.lit("a/"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    file_sink.write_files(files, str(tmp_path))
    assert {x.name: x.read_text() for x in (tmp_path / "a").iterdir()} == {str(i): str(i) for i in range(3000)} and not (tmp_path / "_parts").exists()
