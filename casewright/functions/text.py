"""String functions, the task-map grammars, identifier encoding and fuzzy matching."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Both ends, all white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise_header(name: str) -> str:
    return name.replace("\n", " ").strip()


def fold_header(name: str) -> str:
    """The inverse: every run of white space as one line end, as the form spells its headers."""
    return "\n".join(name.split())


def normalise_headers(df: DataFrame, drop: tuple[str, ...] = ("Case Name [Optional]",)) -> DataFrame:
    """Line ends in headers become spaces; unnamed columns and those in ``drop`` (by literal name) go."""
    named = df.toDF(*map(normalise_header, df.columns))
    return named.drop(*(c for c in named.columns if c.startswith("Unnamed") or c in drop))


def missing_columns(present: list[str], required: list[str]) -> list[str]:
    return sorted(set(required) - set(present))


def is_empty(c: Column) -> Column:
    """Null, empty or exactly one space."""
    return c.isNull() | c.isin("", " ")


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[^./]*$", 0)


def file_kind(path: Column) -> Column:
    """dicom, jpg, mp4, remote or other, by suffix and prefix."""
    ext = F.lower(extension(path))
    return (
        F.when(path.startswith("https://") & F.contains(path, F.lit(".s3.amazonaws.com/")), "remote")
        .when(ext.isin(".dcm", ""), "dicom")
        .when(ext.isin(".jpg", ".jpeg"), "jpg")
        .when(ext == ".mp4", "mp4")
        .otherwise("other")
    )


# --- task maps ------------------------------------------------------------------------------

#: Fixed value: the shape of a semicolon task map.
TASK_SHAPE = r"^\{(?:\s*[^{}]+:\s*[^{}]+(?:;\s*[^{}]+:\s*[^{}]+)*\s*)?\}$"


def unquoted(c: Column) -> Column:
    return F.translate(c, "'\"", "")


def task_notices(c: Column) -> Column:
    """All violated checks of the semicolon grammar, in order."""
    s = unquoted(c)
    return F.array_compact(
        F.array(
            F.when(~(s.startswith("{") & s.endswith("}")), "braces"),
            F.when(~s.rlike(TASK_SHAPE), "shape"),
            F.when(count_char(s, ":") != count_char(s, ";") + 1, "colons"),
        )
    )


def task_map(c: Column) -> Column:
    """``{k: v; k: v}`` as a map with lower-cased keys; null where the text cannot be read."""
    inner = strip(F.regexp_replace(unquoted(c), r"^\{|\}$", ""))
    readable = unquoted(c).rlike(r"^\{.*\}$") & ~inner.rlike(r"(^|;)\s*[^:;]*(;|$)")
    pairs = F.transform(F.split(inner, r"\s*;\s*"), lambda p: F.split(p, r"\s*:\s*", 2))
    keys = F.transform(pairs, lambda p: F.lower(strip(p[0])))
    last = F.map_from_entries(
        F.transform(F.array_distinct(keys), lambda k: F.struct(k, strip(F.element_at(F.filter(pairs, lambda p: F.lower(strip(p[0])) == k), -1)[1])))
    )
    return F.when(readable, last)


def task_keys(c: Column) -> Column:
    """The keys of ``task_map`` alone, in order; null where the text cannot be read."""
    s = unquoted(c)
    inner = strip(F.regexp_replace(s, r"^\{|\}$", ""))
    readable = s.rlike(r"^\{.*\}$") & ~inner.rlike(r"(^|;)\s*[^:;]*(;|$)")
    return F.when(readable, F.array_distinct(F.transform(F.split(inner, ";"), lambda p: F.lower(strip(F.substring_index(p, ":", 1))))))


def task_map_by_comma(c: Column) -> Column:
    """The form's own grammar: ``key: value`` pairs separated by commas; empty tasks are null."""
    keys = F.regexp_extract_all(c, F.lit(r"(\w+)\s*:\s*([^,{}]*)"), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(r"(\w+)\s*:\s*([^,{}]*)"), F.lit(2))
    return F.map_from_arrays(keys, F.transform(values, lambda v: F.nullif(strip(v), F.lit(""))))


# --- identifiers in free text ------------------------------------------------------------------


#: Fixed value: what stands before an encoded identifier.
ENCODED = "HAWKID="


def encode_ids(c: Column, ids: list[tuple[str, str]], prefix: str = ENCODED) -> Column:
    """Every known id becomes ``prefix`` and its uid, one id after another in the given order."""
    if not ids:
        return c
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in ids))
    return F.aggregate(table, c, lambda text, e: F.replace(text, e["k"], F.concat(F.lit(prefix), e["v"])))


def found_ids(c: Column, ids: list[tuple[str, str]]) -> Column:
    """The ids that the sequential encoding would meet."""
    if not ids:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(F.contains(c, F.lit(k)), F.lit(k)) for k, _ in ids)))


# --- fuzzy matching ---------------------------------------------------------------------------


def close_match(candidates: list[str], cutoff: float = 0.6):
    """A vectorised UDF: the candidate most similar by matching blocks, or null; distinct values once."""

    @F.pandas_udf("string")
    def match(values: pd.Series) -> pd.Series:
        best = {v: next(iter(difflib.get_close_matches(v, candidates, 1, cutoff)), None) for v in values.dropna().unique()}
        return values.map(best)

    return match


def map_headers(present: list[str], wanted: list[str], cutoff: float = 0.25) -> dict[str, str | None]:
    """Each wanted header's closest present one; a header is given to one name only."""
    free, out = list(present), {}
    for name in wanted:
        found = difflib.get_close_matches(name, free, 1, cutoff)
        out[name] = found[0] if found else None
        if found:
            free.remove(found[0])
    return out




def register_task_pairs(spark) -> None:
    """``task_pairs(text)`` as a table function of (k, v) for SQL users."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="k string, v string")
    class TaskPairs:
        def eval(self, text: str):
            for part in (text or "").translate({39: None, 34: None}).strip().removeprefix("{").removesuffix("}").split(";"):
                key, colon, value = part.partition(":")
                if colon:
                    yield key.strip().lower(), value.strip()

    spark.udtf.register("task_pairs", TaskPairs)
