"""Archive paths: building, parsing, selecting, conflict checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("project", "subject", "experiment", "scan", "resource")


def build_path(**parts: Column) -> Column:
    """/level/value for every level given, in archive order."""
    return F.concat(*(F.concat(F.lit(f"/{level}/"), parts[level]) for level in LEVELS if level in parts))


def source_label(label: Column) -> Column:
    return F.concat(F.lit("SOURCE_DATA-"), label)


def parse_path(path: Column) -> Column:
    """A map from level to value."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")
    at = F.filter(F.sequence(F.lit(0), F.size(steps) - 2), lambda i: i % 2 == 0)
    return F.map_from_arrays(F.transform(at, lambda i: F.get(steps, i)), F.transform(at, lambda i: F.get(steps, i + 1)))


def select_paths(files: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose level columns equal the given values; ``*`` matches anything."""
    for level, value in wanted.items():
        if value != "*":
            files = files.where(F.col(level) == value)
    return files


def conflicts(planned: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Planned rows that exist already."""
    return planned.join(existing.select(*keys).distinct(), list(keys), "left_semi")
