"""Unique identifiers: validation, spelling, generation."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: dotted numbers without leading zeros.
UID_PATTERN = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"


def dotted(uid: Column) -> Column:
    return F.replace(uid, F.lit("_"), F.lit("."))


def underscored(uid: Column) -> Column:
    return F.replace(uid, F.lit("."), F.lit("_"))


def is_valid_uid(uid: Column) -> Column:
    return dotted(uid).rlike(UID_PATTERN) & (F.length(uid) <= 64)


def derived_uid(key: Column) -> Column:
    """The identifier that belongs to a key: 120 bits of its SHA-256 in decimal, the same on every run."""
    digits = F.sha2(key.cast("binary"), 256)
    high, low = (F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(19,0)") for at in (1, 16))
    return F.concat(F.lit("2_25_"), (high * F.lit(1 << 60).cast("decimal(19,0)") + low).cast("string"))


@F.pandas_udf(StringType())
def new_uid(seed: pd.Series) -> pd.Series:
    """A fresh identifier per row; 128-bit decimals have no built-in."""
    return seed.map(lambda _: f"2_25_{uuid.uuid4().int}")


#: A fresh value on every evaluation.
new_uid = new_uid.asNondeterministic()
