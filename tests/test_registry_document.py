"""The registry document written in parts against the document in one row."""

import json

from pyspark.sql import functions as F

from casewright.sources import registry_json as R


def tables(spark):
    users = spark.createDataFrame([("B", "2", "t", "x"), ("A", "1", "t", None), ("A", "1", "t", ""), ("A", "1", "t", None), ('Q"é\n', "3", None, "x")], "NAME string, UID string, CREATED_DATE_TIME string, CREATED_BY string")
    hashes = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("NAME"), F.col("id").cast("string").alias("UID"), F.lit("t").alias("CREATED_DATE_TIME"), F.lit("x").alias("CREATED_BY"), F.lit("s").alias("SUBJECT"), F.lit(None).cast("string").alias("INSTANCE_NUM"))
    return {"REGISTERED_USERS": users, "GROUPS": users.limit(0), "IMAGE_HASHES": hashes}


def test_the_same_bytes_whatever_the_parts(spark, tmp_path):
    now, own = F.lit("2024-05-05"), tables(spark)
    want = R.document_text(own, "2_25_1", now).first().value
    for n in (1, 7):
        R.write_document(own, str(tmp_path / "doc.json"), "2_25_1", now, partitions=n)
        assert (tmp_path / "doc.json").read_text() == want and json.loads(want)
        assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["doc.json"]
    metadata, back = R.read_registries(spark, str(tmp_path / "doc.json"))
    assert back["IMAGE_HASHES"].count() == 3000 and back["GROUPS"].count() == 0 and metadata.first().CREATED_BY == "2_25_1"
    assert back["REGISTERED_USERS"].count() == 5


def test_a_failure_leaves_the_old_document(spark, tmp_path):
    import pytest

    own, path = tables(spark), str(tmp_path / "doc.json")
    R.write_document(own, path, "2_25_1", F.lit("a"))
    before = (tmp_path / "doc.json").read_bytes()
    broken = own | {"GROUPS": own["REGISTERED_USERS"].withColumn("UID", F.when(F.col("NAME") == "B", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("UID")))}
    with pytest.raises(Exception, match="lost"):
        R.write_document(broken, path, "2_25_1", F.lit("b"))
    assert (tmp_path / "doc.json").read_bytes() == before and not list(tmp_path.glob("*-parts-*"))
