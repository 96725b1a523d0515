"""Keyed registries: lookup, existence, insert-if-absent, referential checks, evolution, deletion.

Every operator is one DataFrame expression; join sides are left to Catalyst, which broadcasts a
registry only when its measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.uids import is_valid_uid


def first_by(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row per key in the given order (never an arbitrary one)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def lookup_uid(probes: DataFrame, name: str, registry: DataFrame, out: str = "uid", order: str = "UID") -> DataFrame:
    """Adds the UID of the first registry row whose NAME equals the upper-cased probe; null if none."""
    names = first_by(registry, F.upper("NAME"), order).select(F.upper("NAME").alias("__name"), F.col("UID").alias(out))
    return probes.join(names, F.upper(F.col(name)) == F.col("__name"), "left").drop("__name")


def lookup_name(probes: DataFrame, uid: str, registry: DataFrame, out: str = "name") -> DataFrame:
    """Adds the NAME behind a UID; null if the UID is unknown."""
    names = first_by(registry, F.col("UID"), "NAME").select(F.col("UID").alias("__uid"), F.col("NAME").alias(out))
    return probes.join(names, F.col(uid) == F.col("__uid"), "left").drop("__uid")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows pass unchanged; one that breaks the condition (or leaves it null) fails the job."""
    fine = F.coalesce(condition, F.lit(False))
    return df.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def member_flag(probes: DataFrame, name: str, registry: DataFrame, out: str, ignore_case: bool = True) -> DataFrame:
    """Adds whether the value is a registry NAME, with or without regard to case."""
    fold = F.upper if ignore_case else (lambda c: F.col(c) if isinstance(c, str) else c)
    names = registry.select(fold("NAME").alias("__name")).where(F.col("__name").isNotNull()).distinct()
    return probes.join(names, fold(name) == F.col("__name"), "left").withColumn(out, F.col("__name").isNotNull()).drop("__name")


def insert_if_absent(registry: DataFrame, candidates: DataFrame, accessor: str, now: Column, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """(the registry with the new rows, every candidate with ``inserted`` and ``reason``).

    Names are upper-cased; the first candidate of a name in ``order`` wins; a name that exists or an
    invalid UID is refused.  Extra columns are matched by name, unknown ones are an error.
    """
    extras = [c for c in candidates.columns if c not in ("NAME", "UID", order)]
    if unknown := set(extras) - set(registry.columns):
        raise ValueError(f"unknown extra columns {sorted(unknown)}")
    known = registry.select(F.upper("NAME").alias("__known")).distinct()
    rank = F.row_number().over(Window.partitionBy(F.upper("NAME"), is_valid_uid(F.col("UID"))).orderBy(order, "UID"))
    judged = (
        candidates.withColumn("__rank", rank)
        .join(known, F.upper("NAME") == F.col("__known"), "left")
        .withColumn(
            "reason",
            F.when(~F.coalesce(is_valid_uid(F.col("UID")), F.lit(False)), "invalid uid").when(F.col("__known").isNotNull(), "exists").when(F.col("__rank") > 1, "repeated").otherwise("ok"),
        )
        .withColumn("inserted", F.col("reason") == "ok")
        .drop("__known", "__rank")
    )
    added = judged.where("inserted").select(
        F.upper("NAME").alias("NAME"), "UID", now.alias("CREATED_DATE_TIME"), F.lit(accessor).alias("CREATED_BY"), *extras
    )
    return registry.unionByName(added, allowMissingColumns=True), judged


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys count as orphans."""
    return child.join(parent.select(F.col(parent_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def evolve(registry: DataFrame, *columns: str) -> DataFrame:
    """Missing columns are added as nulls."""
    return registry.withColumns({c: F.lit(None).cast("string") for c in columns if c not in registry.columns})


def delete_keys(df: DataFrame, key: str, keys: DataFrame, keys_key: str) -> DataFrame:
    """Deletion keeps the complement."""
    return df.join(keys.select(F.col(keys_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """Items and columns per table."""
    rows = [df.agg(F.count("*").alias("n_items")).select(F.lit(n).alias("table_name"), "n_items", F.lit(len(df.columns)).cast("bigint").alias("n_columns")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def guard(caller: str, users: DataFrame, librarians: DataFrame | None = None) -> None:
    """Before a mutation: the caller must be registered and, where asked, a librarian."""
    for who, message in ((users, "is not a registered user"), (librarians, "is not a librarian")):
        if who is not None and not who.where(F.col("NAME") == caller.upper()).limit(1).count():
            raise PermissionError(f"{caller!r} {message}")


class Catalog:
    """The registries by name; tables are added, listed and read, names upper-cased."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self._tables = {k.upper(): v for k, v in tables.items()}

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def exists(self, name: str) -> bool:
        return name.upper() in self._tables

    def get(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(f"no registry {name.upper()!r}")
        return self._tables[name.upper()]

    def items(self, name: str) -> DataFrame:
        return self.get(name).select("NAME")

    def add_items(self, name: str, candidates: DataFrame, caller: str, caller_uid: str, now: Column, order: str = "ordinal") -> tuple[Catalog, DataFrame]:
        """(the catalog with the new items, every candidate's outcome); the caller must be a registered user."""
        guard(caller, self.get("REGISTERED_USERS"))
        grown, outcome = insert_if_absent(self.get(name), candidates, caller_uid, now, order)
        return self.with_table(name, grown), outcome

    def with_table(self, name: str, table: DataFrame) -> Catalog:
        return Catalog(self._tables | {name.upper(): table})

    def add_table(self, spark, name: str, *extras: str) -> Catalog:
        from casewright.schemas import registry_schema

        if self.exists(name):
            raise ValueError(f"registry {name.upper()!r} exists")
        return self.with_table(name, spark.createDataFrame([], registry_schema(*(e.upper() for e in extras))))


def seeded(spark, librarian: str, now: Column, sites: tuple[str, ...] = ("SITE_ONE", "SITE_TWO"), groups: tuple[str, ...] = (), surgeons: tuple[tuple[str, str, str, str], ...] = ()) -> Catalog:
    """A new catalog of the six registries: the librarian as its user, the given sites, groups and surgeons
    (name, first name, last name, middle initial), no subjects and no hashes.  Each UID belongs to table and name."""
    from casewright.functions.uids import derived_uid
    from casewright.schemas import REGISTRY_EXTRAS, registry_schema

    rows = {"REGISTERED_USERS": [(librarian,)], "ACQUISITION_SITES": [(s,) for s in sites], "GROUPS": [(g,) for g in groups], "SURGEONS": list(surgeons)}
    tables = {}
    for name, extras in REGISTRY_EXTRAS.items():
        schema = registry_schema(*extras)
        given = ["NAME", *(extras if name == "SURGEONS" else ())]
        df = spark.createDataFrame(rows.get(name, []), ", ".join(f"`{c}` string" for c in given)).withColumn("NAME", F.upper("NAME"))
        stamp = {"UID": derived_uid(F.concat(F.lit(f"{name}:"), F.col("NAME"))), "CREATED_DATE_TIME": now.cast("string"), "CREATED_BY": derived_uid(F.lit(f"REGISTERED_USERS:{librarian.upper()}"))}
        empty = {c: F.lit(None).cast("string") for c in extras if c not in given}
        tables[name] = df.withColumns(stamp | empty).select(*schema.names)
    return Catalog(tables)


def register_user(users: DataFrame, librarians: DataFrame, caller: str, name: str, uid: str, now: Column) -> DataFrame:
    """A librarian adds a user; adding one twice changes nothing."""
    guard(caller, users, librarians)
    candidate = users.sparkSession.createDataFrame([(name, uid, 1)], "NAME string, UID string, ordinal int")
    return insert_if_absent(users, candidate, caller.upper(), now)[0]


def delete_subjects(keys: DataFrame, key: str, subjects: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects go together with their image hashes."""
    return delete_keys(subjects, "UID", keys, key), delete_keys(hashes, "SUBJECT", keys, key)
