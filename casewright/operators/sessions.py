"""Session frames: duplicate flags, validity, instance numbers, file names, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.text import extension


def flag_duplicates(files: DataFrame, session: str, digest: str, *order: str, valid: str = "is_valid", out: str = "is_questionable") -> DataFrame:
    """Among valid rows the first of a hash is false and later ones true; invalid rows are null."""
    rank = F.row_number().over(Window.partitionBy(session, digest, valid).orderBy(*order))
    return files.withColumn(out, F.when(F.col(valid), rank > 1))


def drop_duplicates(files: DataFrame, session: str, digest: str, *order: str, valid: str = "is_valid") -> DataFrame:
    """Later duplicates of a hash lose their validity."""
    rank = F.row_number().over(Window.partitionBy(session, digest, valid).orderBy(*order))
    return files.withColumn(valid, F.col(valid) & (rank == 1))


def seen_flag(files: DataFrame, digest: str, registry: DataFrame, registry_digest: str, out: str = "seen") -> DataFrame:
    known = registry.select(F.col(registry_digest).alias("__seen")).distinct()
    return files.join(known, F.col(digest) == F.col("__seen"), "left").withColumn(out, F.col("__seen").isNotNull()).drop("__seen")


def only_new(files: DataFrame, digest: str, registry: DataFrame, registry_digest: str) -> DataFrame:
    return files.join(registry.select(F.col(registry_digest).alias("__seen")), F.col(digest) == F.col("__seen"), "left_anti")


def only_seen(files: DataFrame, digest: str, registry: DataFrame, registry_digest: str) -> DataFrame:
    return files.join(registry.select(F.col(registry_digest).alias("__seen")), F.col(digest) == F.col("__seen"), "left_semi")


def valid_new(seen: str, template: str) -> Column:
    """A source image counts if its hash is new and it is no template."""
    return ~F.col(seen) & ~F.col(template)


def valid_known(seen: str, template: str) -> Column:
    """A label's image counts if its hash is known and it is no template."""
    return F.col(seen) & ~F.col(template)


def extension_gate(files: DataFrame, path: str, wanted: str = ".dcm", valid: str = "is_valid") -> DataFrame:
    """Files with another extension (case counts) stay as rows but are not valid."""
    return files.withColumn(valid, F.col(valid) & (extension(F.col(path)) == wanted))


def instance_numbers(files: DataFrame, session: str, *order: str, out: str = "instance_num") -> DataFrame:
    """1-based position in the given order; name a tie-breaker."""
    return files.withColumn(out, F.row_number().over(Window.partitionBy(session).orderBy(*order)))


def file_name(instance: Column, uid: Column) -> Column:
    """Four-digit number and uid; the number is padded if below 1000 and must not be longer than four."""
    number = instance.cast("string")
    padded = F.when(number.rlike(r"^\d+$") & (F.length(number) < 4), F.lpad(number, 4, "0")).otherwise(number)
    safe = F.when(F.length(padded) <= 4, padded).otherwise(F.raise_error(F.concat(F.lit("instance number too long: "), padded)).cast("string"))
    return F.concat_ws("-", safe, uid)


def video_numbers(files: DataFrame, session: str, *order: str, out: str = "video_num") -> DataFrame:
    """The first video is 000, later ones count on after all files of the session."""
    each = Window.partitionBy(session)
    rank = F.row_number().over(each.orderBy(*order))
    later = F.lpad((F.count("*").over(each) + rank - 1).cast("string"), 3, "0")
    return files.withColumn(out, F.when(rank == 1, "000").otherwise(later))


def session_validity(files: DataFrame, session: str, subjects: DataFrame, subject_uid: str, valid: str = "is_valid") -> DataFrame:
    """A session is valid if it has a valid file and its subject is new."""
    known = subjects.select(F.col(subject_uid).alias("__known")).distinct()
    judged = files.groupBy(session).agg(F.bool_or(valid).alias("any_valid"), F.bool_and(valid).alias("all_valid"), F.count_if(valid).alias("n_valid"))
    return (
        judged.join(known, F.col(session) == F.col("__known"), "left")
        .withColumn("session_valid", F.col("any_valid") & F.col("__known").isNull())
        .drop("__known")
    )


def head_and_tail(files: DataFrame, n: int, *order: str) -> DataFrame:
    """The first and last ``n`` rows in the given order: two bounded top-k selections."""
    first = files.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    last = files.orderBy(*(F.col(o).desc() for o in order)).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


#: Archive schema prefix and scan label of each session class.
SESSION_CLASSES = {"RF": ("rf", "DICOM"), "ESV": ("esv", "DICOM_MP4"), "OTHER": ("otherDicom", "DERIVED")}


def session_class(kind: Column) -> Column:
    pick = F.lit(None).cast("struct<prefix:string,scan:string>")
    for name, (prefix, scan) in SESSION_CLASSES.items():
        pick = F.when(kind == name, F.struct(F.lit(prefix).alias("prefix"), F.lit(scan).alias("scan"))).otherwise(pick)
    return pick


def first_of_batch(files: DataFrame, digest: str, *order: str) -> DataFrame:
    """The first row of every hash in the given order."""
    rank = F.row_number().over(Window.partitionBy(digest).orderBy(*order))
    return files.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
