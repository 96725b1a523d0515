"""Registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casewright.plans import dq, files, registries, search, sessions, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (search, registries, sessions, dq, values, files):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
