"""Searching catalogs: semi-joins, keep lists, renames, contains filters, distinct values, flag counts, encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def belonging_to(rows: DataFrame, key: str, found: DataFrame, found_key: str) -> DataFrame:
    """The rows whose key is among those of another result, once each; the list of keys never leaves Spark."""
    keys = found.select(F.col(found_key).alias("#key")).where(F.col("#key").isNotNull()).distinct()
    return rows.join(keys, F.col(key) == F.col("#key"), "left_semi")


def projected(rows: DataFrame, drop: tuple[str, ...] = (), rename: dict[str, str] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns dropped, then renamed, then those of the keep list that are there, in their own order."""
    renamed = rows.drop(*drop).withColumnsRenamed(rename or {})
    return renamed if keep is None else renamed.select(*(F.col(f"`{c}`") for c in renamed.columns if c in keep))


def containing(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows of which some named column holds the given text; a name ending in ``__any_case`` ignores case."""

    def test(name: str, text: str) -> Column:
        column = name.removesuffix("__any_case")
        return F.contains(F.col(column), F.lit(text)) if column == name else F.contains(F.lower(column), F.lit(text.lower()))

    return rows.where(reduce(lambda a, b: a | b, (test(*x) for x in wanted.items())))


def distinct_values(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.select(value.alias(name)).distinct()


def flag_counts(rows: DataFrame, by: str, counts: dict[str, Column], any_of: dict[str, Column] | None = None, all_of: dict[str, Column] | None = None) -> DataFrame:
    """Per group: rows with a flag, all rows as ``n``, whether some row has a flag and whether all have one."""
    parts = [F.count_if(c).alias(n) for n, c in counts.items()] + [F.count("*").alias("n")]
    parts += [F.bool_or(c).alias(n) for n, c in (any_of or {}).items()] + [F.bool_and(c).alias(n) for n, c in (all_of or {}).items()]
    return rows.groupBy(by).agg(*parts)


def success_ratio(outcome: DataFrame, inserted: str = "inserted") -> DataFrame:
    """``n_inserted, n, ratio`` of an insert's outcome; the ratio of nothing is null."""
    done = F.count_if(F.col(inserted))
    return outcome.agg(done.alias("n_inserted"), F.count("*").alias("n"), F.try_divide(done.cast("double"), F.count("*")).alias("ratio"))


def coded_names(names: DataFrame, name: str, first: Column) -> DataFrame:
    """``code`` and ``option`` of names in two classes, each lettered and numbered in order of its names: ``1A``, ``2C``.

    The list is a menu of at most 26 names a class; a longer one is an error.
    """
    number = F.row_number().over(Window.partitionBy(first).orderBy(name))
    letter = F.when(number <= 26, F.char(64 + number)).otherwise(F.raise_error(F.lit("more than 26 names in a class")).cast("string"))
    return names.select(name, F.concat(F.when(first, "1").otherwise("2"), letter).alias("code"), number.cast("string").alias("option"))


def merged_codes(first: Column, second: Column) -> Column:
    """Two maps of codes as one; where both have a key the second's value counts."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def filled(rows: DataFrame) -> DataFrame:
    """Every column as text with nulls empty, as a sheet is read."""
    return rows.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns))


def masked(text: Column) -> Column:
    """A star for every character."""
    return F.repeat(F.lit("*"), F.length(text))


def encoded_subjects(subjects: DataFrame, group: str, groups: DataFrame, group_key: str, site: str, sites: DataFrame, site_key: str) -> DataFrame:
    """Subjects with the row of their group and of that group's site, by two keyed joins; unknown ones stay null."""
    with_group = subjects.join(groups, F.col(group) == F.col(group_key), "left")
    return with_group.join(sites, F.col(site) == F.col(site_key), "left")


def json_form(text: Column, schema: str) -> Column:
    """A JSON form read with a fixed schema, rendered in its order and read again: what a reload would give."""
    return F.from_json(F.to_json(F.from_json(text, schema)), schema)


def levels(values: Column) -> Column:
    """Numbers stretched from 0 to 255 and cut to whole ones; equal numbers are all 0."""
    low, high = F.array_min(values).cast("double"), F.array_max(values).cast("double")
    return F.transform(values, lambda x: F.when(high > low, F.floor((x.cast("double") - low) / (high - low) * 255)).otherwise(F.lit(0).cast("bigint")))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
