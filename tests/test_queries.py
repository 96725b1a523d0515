"""Every registered engine query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from casewright.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = sql.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    left = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert left == right and left


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_without_twin(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_is_stable(spark):
    assert entry.entry(spark).columns == ["row_num", "expt_id", "procedure", "operation_date", "upload_time"]
