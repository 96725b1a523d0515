"""Dates whose parts stand in any order."""

import datetime

import pytest
from pyspark.sql import functions as F

from casewright.functions import timeutil

AT = datetime.datetime
CASES = {
    "Mar 5, 2024 3:07 PM": AT(2024, 3, 5, 15, 7),
    "5 March 2024": AT(2024, 3, 5),
    "Tuesday, March 5th 2024 at 12:30:15 am": AT(2024, 3, 5, 0, 30, 15),
    "2024 Mar 05 23:59:59.25": AT(2024, 3, 5, 23, 59, 59, 250000),
    "3/5/2024": AT(2024, 3, 5),
    "25/3/2024 7pm": AT(2024, 3, 25, 19),
    "3-5-24 08:00": AT(2024, 3, 5, 8),
    "2024/3/5 08:00:01": AT(2024, 3, 5, 8, 0, 1),
    "12:15 PST Jul 4 2023": AT(2023, 7, 4, 14, 15),
    "2023-07-04T12:15:00Z": AT(2023, 7, 4, 7, 15),
    "2023-07-04 12:15:00+02:00": AT(2023, 7, 4, 5, 15),
    "4 Jul 2023 12:15 EDT": AT(2023, 7, 4, 11, 15),
    "Jan 2 '99": AT(1999, 1, 2),
    "Feb 30 2024": None,
    "March 2024": None,
    "13:00 PM 1/1/2024": None,
    "no date at all": None,
    "": None,
}


@pytest.mark.parametrize("form", ["tolerant", "central"])
def test_spellings(spark, form):
    df = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", getattr(timeutil, form)(F.col("t")).alias("at"))
    assert {r.t: r.at for r in df.collect()} == CASES


def test_the_plan_is_built_in(spark):
    df = spark.createDataFrame([("x",)], "t string").select(timeutil.central(F.col("t")).alias("at"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().at is None and spark.range(1).select(timeutil.central(F.lit(None).cast("string")).alias("a")).first().a == AT(1900, 1, 1)
