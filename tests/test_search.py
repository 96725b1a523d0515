"""Search helpers, forms as files, seeded registries."""

import pytest
from pyspark.sql import functions as F

from casewright.functions import text
from casewright.operators import publish, registry, search


def test_projection_filters_and_counts(spark):
    df = spark.createDataFrame([(1, "Knee ARTHRO", None), (2, "hip", 5), (3, "arthro", 5)], "id int, name string, x int")
    assert search.projected(df, ("x",), {"id": "key"}, ("name", "key", "none")).columns == ["key", "name"]
    assert [r.id for r in search.containing(df, name="ARTHRO").collect()] == [1]
    assert sorted(r.id for r in search.containing(df, name__any_case="Arthro").collect()) == [1, 3]
    found = spark.createDataFrame([(3,), (3,), (None,)], "k int")
    assert [r.id for r in search.belonging_to(df, "id", found, "k").collect()] == [3]
    assert [tuple(r) for r in search.filled(df).orderBy("id").collect()] == [("1", "Knee ARTHRO", ""), ("2", "hip", "5"), ("3", "arthro", "5")]
    assert [tuple(r) for r in search.success_ratio(spark.createDataFrame([(True,), (False,)], "inserted boolean")).collect()] == [(1, 2, 0.5)]
    assert search.success_ratio(spark.createDataFrame([], "inserted boolean")).first().ratio is None
    row = spark.range(1).select(search.merged_codes(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), search.levels(F.array(F.lit(2), F.lit(2))).alias("flat")).first()
    assert row.m == {"a": "1", "b": "3"} and row.flat == [0, 0]
    assert text.fold_header("Epic  Start\tTime") == "Epic\nStart\nTime"
    many = spark.range(27).select(F.format_string("n%02d", "id").alias("name"))
    with pytest.raises(Exception, match="26 names"):
        search.coded_names(many, "name", F.lit(True)).collect()


def test_forms_are_one_file_each_under_free_names(spark, tmp_path):
    forms = lambda *rows: spark.createDataFrame(list(rows), "name string, value string, who string")
    out = str(tmp_path / "forms")
    publish.write_forms(forms(("a.json", "1", "s"), ("b", "2", "s"), ("c.x.json", "3", "s"), ("c.x.json", "4", "t")), out)
    publish.write_forms(forms(("a.json", "5", "s"), ("b", "6", "s")), out)
    publish.write_forms(forms(("a.json", "7", "s")), out)
    got = {p.name: p.read_text() for p in (tmp_path / "forms").iterdir() if not p.name.startswith(".")}
    assert got == {"a.json": "1", "a-copy.json": "5", "a-copy2.json": "7", "b": "2", "b-copy": "6", "c.x.json": "3", "c.x-copy.json": "4"}
    by = str(tmp_path / "by")
    publish.write_forms(forms(("a.json", "1", "s"), ("a.json", "2", "t")), by, "who")
    publish.write_forms(forms(("a.json", "3", "t")), by, "who")
    assert sorted((str(p.relative_to(by)), p.read_text()) for p in (tmp_path / "by").rglob("*.json")) == [("s/a.json", "1"), ("t/a-copy.json", "3"), ("t/a.json", "2")]


def test_seeded_registries_agree_with_each_other(spark):
    c = registry.seeded(spark, "lib_one", F.lit("2024-01-01"), groups=("KNEE",), surgeons=(("surgeon_001", "A", "B", "C"),))
    assert c.tables() == ["ACQUISITION_SITES", "GROUPS", "IMAGE_HASHES", "REGISTERED_USERS", "SUBJECTS", "SURGEONS"]
    assert registry.orphans(c.get("SURGEONS"), "CREATED_BY", c.get("REGISTERED_USERS"), "UID").count() == 0
    row = c.get("SURGEONS").first()
    assert (row.NAME, row.LAST_NAME) == ("SURGEON_001", "B") and c.get("SUBJECTS").columns[-2:] == ["ACQUISITION_SITE", "GROUP"]
    grown, outcome = c.add_items("GROUPS", spark.createDataFrame([("hip", "2.25.4", 0), ("knee", "2.25.5", 1)], "NAME string, UID string, ordinal int"), "LIB_ONE", row.CREATED_BY, F.lit("t"))
    assert [tuple(r) for r in search.success_ratio(outcome).collect()] == [(1, 2, 0.5)] and grown.items("GROUPS").count() == 2
