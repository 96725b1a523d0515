"""Crowd-sourced labels: grouping with ordinals, two-hop lookups, stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions.uids import dotted

def find_column(columns: list[str], part: str) -> str:
    """The first column whose name holds ``part``."""
    found = next((c for c in columns if part in c), None)
    if found is None:
        raise ValueError(f"no column holds {part!r}")
    return found


def collect_in_order(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Per key the values as lists in the order of ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    grouped = df.groupBy(key).agg(rows.alias("__rows"))
    pick = lambda name: F.transform("__rows", lambda row: row[name]).alias(name)
    return grouped.select(key, *map(pick, values))


def segment_numbers(df: DataFrame, key: str, *order: str, out: str = "segment") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def two_hop(df: DataFrame, digest: str, hashes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Hash -> subject uid -> subject name."""
    first = hashes.select(F.col("NAME").alias("__hash"), F.col("SUBJECT").alias("subject_uid"))
    second = subjects.select(F.col("UID").alias("__uid"), F.col("NAME").alias("subject_name"))
    return df.join(first, F.upper(F.col(digest)) == F.col("__hash")).join(second, F.col("subject_uid") == F.col("__uid")).drop("__hash", "__uid")


#: Labels in one task of a grouped check.
TASK_ROWS = 1 << 19


def group_validity(labels: DataFrame, key: str, digest: str, hashes: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Per key its labels, its different images, and whether the registry (``NAME``) knows every image.

    The labels are dealt over as many tasks as their number asks for, by image and then by group, so what a task sorts
    and counts does not grow with the input; within a group equal images become one row before they are counted.
    """
    spark = labels.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-labels.count() // task_rows))
    known = hashes.select(F.col("NAME").alias("__known")).repartition(tasks, "__known").distinct()
    joined = labels.select(key, digest).repartition(tasks, digest).join(known, F.col(digest) == F.col("__known"), "left")
    images = joined.repartition(tasks, key).groupBy(key, digest).agg(F.count("*").alias("__n"), F.bool_and(F.col("__known").isNotNull()).alias("__ok"))
    return images.groupBy(key).agg(F.sum("__n").alias("n_labels"), F.bool_and("__ok").alias("is_valid"), F.count(digest).alias("n_images"))


def batch_id(path: Column) -> Column:
    return F.regexp_extract(path, r"Batch_(\d+)_batch_results\.csv", 1)


#: What every label header says of itself.
SEGMENT_HEADER = {"Modality": "SEG", "SeriesDescription": "crowd labels", "ContentLabel": "SEGMENTATION"}


def segment_headers(df: DataFrame, key: str, order: str, worker: str, title: str) -> DataFrame:
    """One header map per key: fixed entries, the first row's title, and its segments in order."""
    lists = collect_in_order(df, key, order, worker, title)
    fixed = [x for k, v in SEGMENT_HEADER.items() for x in (F.lit(k), F.lit(v))]
    header = F.create_map(
        *fixed, F.lit("StudyDescription"), F.get(title, F.lit(0)), F.lit("NumberOfFrames"), F.size(worker).cast("string"),
        F.lit("SegmentSequence"), F.array_join(F.transform(worker, lambda w, i: F.concat_ws(":", i.cast("string"), w)), ";"),
    )
    return lists.select(key, header.alias("header"))


#: The class of structured reports, and the code that every item of one has for its text.
REPORT_CLASS, TEXT_CODE = "1.2.840.10008.5.1.4.1.1.88.11", ("121071", "DCM", "Textual description")


def report_header(uid: Column, group: Column, at: Column, notes: Column) -> Column:
    """The header of a group's label file, as a map for ``dicom.encode``: an item of the content sequence for every note.

    The person, the birth date and the sex are fixed, ``at`` is the time of the first label.
    """
    item = lambda i, rest: F.concat(F.lit("0040A730["), i.cast("string"), F.lit(f"].{rest}"))
    entry = lambda path, kind, value: F.struct(path.alias("key"), F.struct(F.lit(kind).alias("vr"), value.alias("value")).alias("value"))
    code, scheme, meaning = TEXT_CODE
    fixed = {
        "00020002": ("UI", F.lit(REPORT_CLASS)), "00020003": ("UI", dotted(uid)), "00020010": ("UI", F.lit("1.2.840.10008.1.2.1")),
        "00080016": ("UI", F.lit(REPORT_CLASS)), "00080018": ("UI", dotted(uid)), "00080023": ("DA", F.date_format(at, "yyyyMMdd")), "00080033": ("TM", F.date_format(at, "HHmmss")),
        "00080050": ("LO", group), "00080060": ("CS", F.lit("SR")), "00100010": ("PN", F.lit("REDACTED")), "00100020": ("LO", F.lit("REDACTED")), "00100030": ("DA", F.lit("19000101")), "00100040": ("CS", F.lit("O")),
        "00280004": ("CS", F.lit("RGB")), "00280100": ("US", F.lit("8")), "00280101": ("US", F.lit("8")), "00280102": ("US", F.lit("7")), "00280103": ("US", F.lit("0")),
    }

    def items(note: Column, i: Column) -> Column:
        below = {"0040A040": ("CS", F.lit("TEXT")), "0040A160": ("UT", note), "0040A043[0].00080100": ("SH", F.lit(code)), "0040A043[0].00080102": ("SH", F.lit(scheme)), "0040A043[0].00080104": ("LO", F.lit(meaning))}
        return F.array(*(entry(item(i, rest), kind, value) for rest, (kind, value) in below.items()))

    own = F.array(*(entry(F.lit(tag), kind, F.coalesce(value, F.lit(""))) for tag, (kind, value) in fixed.items()))
    return F.map_from_entries(F.concat(own, F.flatten(F.transform(notes, items))))
