"""What the nearest names are worked out from is written once and read back, not worked out for every step."""

from casewright.operators import similar


def test_values_names_and_pairs_are_kept(spark, tmp_path):
    kept = []

    def keep(df, name):
        kept.append(name)
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    values = spark.createDataFrame([("amber",), ("amber",), ("", ), (None,), ("xyz",)], "value string")
    names = spark.createDataFrame([("ambre",), ("amber1",), ("",), (None,)], "name string")
    got = {r.value: (r.name, r.ratio) for r in similar.nearest(values, names, keep=keep).collect()}
    assert kept == ["values", "names", "pairs"]
    assert got == {r.value: (r.name, r.ratio) for r in similar.nearest(values, names).collect()} and set(got) == {"amber", ""}
