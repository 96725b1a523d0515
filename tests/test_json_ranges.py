"""A registry document read by byte ranges, and the digest of an ordered text, against the whole value in one place."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from casewright.operators.digest import ordered_digest
from casewright.sources import json_ranges
from casewright.sources import registry_json as R

ODD = ['a{"', 'x},{"NAME":"y', "back\\", 'q\\"{[', "é\n]}", "", ":[{", '"tables": {"GROUPS": [{"NAME": "no"}]}', "\\" * 9]


def document(layout):
    row = lambda i: {"NAME": f"{i}{ODD[i % len(ODD)]}", "UID": ODD[(i + 3) % len(ODD)], "more": {"a": [{"NAME": "inner"}]}, "CREATED_BY": None}
    tables = {"GROUPS": [row(i) for i in range(40)], "UN\"KNOWN": [row(i) for i in range(3)], "SURGEONS": [], "SUBJECTS": [row(i) for i in range(60, 90)]}
    return tables, json.dumps({"metadata": {"CREATED": "t", "TABLE_EXTRA_COLUMNS": {"SUBJECTS": ["GROUP"], "GROUPS": []}}, "tables": tables, "after": {"GROUPS": [{"NAME": "not a table"}]}}, **layout)


@pytest.mark.parametrize("layout", [{}, {"separators": (",", ":")}, {"indent": 3, "ensure_ascii": False}])
@pytest.mark.parametrize("chunk", [61, 217, 1 << 22])
def test_rows_whatever_the_ranges(spark, tmp_path, layout, chunk):
    tables, text = document(layout)
    raw = text.encode()
    (tmp_path / "d.json").write_bytes(raw)
    got = json_ranges.table_rows(spark, [(str(tmp_path / "d.json"), len(raw))], chunk).collect()
    for name, rows in tables.items():
        assert sorted((json.loads(bytes(r.row)) for r in got if r.name == name), key=lambda r: r["NAME"]) == sorted(rows, key=lambda r: r["NAME"])
    assert len(got) == sum(map(len, tables.values()))


def test_registries_are_not_parsed_as_one_value(spark, tmp_path):
    tables, text = document({"indent": 1})
    (tmp_path / "d.json").write_text(text)
    metadata, found = R.read_registries(spark, str(tmp_path / "d.json"))
    assert metadata.first().CREATED == "t" and found["SURGEONS"].count() == found["IMAGE_HASHES"].count() == 0
    assert sorted((r.NAME, r.UID) for r in found["GROUPS"].collect()) == sorted((r["NAME"], r["UID"]) for r in tables["GROUPS"])
    assert "explode" not in found["GROUPS"]._jdf.queryExecution().analyzed().toString()
    (tmp_path / "d.json").write_text(text[:-5])
    assert R.read_registries(spark, str(tmp_path / "d.json"))[1]["GROUPS"].count() == 0


def test_digest_of_an_ordered_text(spark, tmp_path):
    for n, sep in ((0, "|"), (1, "|"), (500, "||")):
        lines = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
        want = sep.join(sorted(r.k for r in lines.collect()))
        got = ordered_digest(lines.repartition(5), F.col("k"), "k", separator=sep, folder=str(tmp_path / f"d{n}")).first()
        assert (got.n, got.digest) == (n, hashlib.sha256(want.encode()).hexdigest())
