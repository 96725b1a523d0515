"""Header maps (path -> vr, value): redaction and derived metadata, with higher-order functions.

A path names the sequences above an element, ``0040A730[0].0040A123``; a tag alone is a path.  Persons, curves and
private elements are met at any depth, and with a sequence goes all that stands below; overlays, accession number
and study id are elements of the file itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "REDACTED PYTHON VALUE"


def redact_persons(tags: Column, text: str = REDACTED) -> Column:
    """Every element of the person-name kind, inside sequences too."""
    return F.transform_values(tags, lambda k, v: F.when(v["vr"] == "PN", F.struct(v["vr"].alias("vr"), F.lit(text).alias("value"))).otherwise(v))


def drop_curves(tags: Column) -> Column:
    """Elements of the groups 50xx, and what stands below them."""
    return F.map_filter(tags, lambda k, v: ~k.rlike(r"(^|\.)50"))


def drop_private(tags: Column) -> Column:
    """Elements of odd groups, and what stands below them."""
    return F.map_filter(tags, lambda k, v: ~F.upper(k).rlike(r"(^|\.)[0-9A-F]{3}[13579BDF]"))


def drop_overlays(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~F.upper(k).rlike(r"^60[0-9A-F][02468ACE]3000($|\[)"))


def overwrite(tags: Column, tag: str, value: str) -> Column:
    """Only where the tag is present."""
    return F.transform_values(tags, lambda k, v: F.when(k == tag, F.struct(v["vr"].alias("vr"), F.lit(value).alias("value"))).otherwise(v))


#: Accession number and study id.
ACCESSION, STUDY_ID = "00080050", "00200010"


def redact(tags: Column) -> Column:
    cleaned = drop_overlays(drop_private(drop_curves(redact_persons(tags))))
    return overwrite(overwrite(cleaned, ACCESSION, REDACTED), STUDY_ID, REDACTED)


def first_filled(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def header_time(content_date: Column, content_time: Column, created_date: Column, created_time: Column) -> Column:
    """Content date and time if the content date is present (an empty one does not fall through)."""
    joined = lambda d, t: F.when((d != "") & (F.coalesce(t, F.lit("")) != ""), F.concat_ws(" ", d, t))
    return F.when(content_date.isNotNull(), joined(content_date, content_time)).otherwise(joined(created_date, created_time))


def uid_elements(names: Column) -> Column:
    """Elements with UID in their name, dots spelled as underscores."""
    return F.transform_values(F.map_filter(names, lambda k, v: F.contains(k, F.lit("UID"))), lambda k, v: F.replace(v, F.lit("."), F.lit("_")))


def uid_values(tags: Column) -> Column:
    """Path -> value of every identifier element at any depth, dots spelled as underscores."""
    return F.transform_values(F.map_filter(tags, lambda k, v: v["vr"] == "UI"), lambda k, v: F.replace(v["value"], F.lit("."), F.lit("_")))


def time_elements(names: Column) -> Column:
    return F.map_filter(names, lambda k, v: k.isin("ContentTime", "SeriesTime", "StudyTime"))


def stash_and_set(names: Column, values: dict[str, Column]) -> Column:
    """Standard values over the header; each old value is kept under a tag of its own."""
    old = F.map_from_entries(F.array_compact(F.array(*(F.when(F.map_contains_key(names, F.lit(k)), F.struct(F.lit(f"Old{k}").alias("key"), F.element_at(names, F.lit(k)).alias("value"))) for k in values))))
    rest = F.map_filter(names, lambda k, v: ~k.isin(*values))
    return F.map_concat(rest, old, F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))))


#: Fixed value: of several header times the last of these that is present counts.
SERIES_TIMES = ("SeriesTime", "ContentTime", "StudyTime")


def last_time(header: str) -> Column:
    """The last present of the series, content and study time; null where none is."""
    return F.coalesce(*(F.element_at(header, F.lit(name)) for name in reversed(SERIES_TIMES)))


#: The class of endoscopic still images and what their headers say of the pixels.
STILL_CLASS, STILL_TYPE = "1.2.840.10008.5.1.4.1.1.77.1.1.1", ("ORIGINAL", "PRIMARY", "ARTHRO_DIAGN_IMG")


def still_header(uid: Column, parent_uid: Column, media_uid: Column, number: Column, taken_date: Column, taken_time: Column, site: Column, path: Column, now_date: Column, now_time: Column) -> Column:
    """The header that a still image without one gets, as a map for ``dicom.encode``; rows and columns are the writer's.

    Identifiers may be spelled with underscores.  The person and the patient's id are redacted from the start.
    """
    dotted = lambda c: F.replace(c, F.lit("_"), F.lit("."))
    entries = {
        "00020002": ("UI", F.lit(STILL_CLASS)),
        "00020003": ("UI", dotted(media_uid)),
        "00020010": ("UI", F.lit("1.2.840.10008.1.2")),
        "00020012": ("UI", dotted(parent_uid)),
        "00080008": ("CS", F.lit("\\".join(STILL_TYPE))),
        "00080012": ("DA", taken_date),
        "00080013": ("TM", F.lit("")),
        "00080020": ("DA", taken_date),
        "00080023": ("DA", now_date),
        "00080030": ("TM", taken_time),
        "00080033": ("TM", now_time),
        "00080060": ("CS", F.lit("ES")),
        "00080080": ("LO", site),
        "0008103E": ("LO", F.concat(F.lit("Arthro. Diagn. Img. #"), number.cast("string"))),
        "00100010": ("PN", F.lit(REDACTED)),
        "00100020": ("LO", F.lit(REDACTED)),
        "0020000D": ("UI", dotted(parent_uid)),
        "0020000E": ("UI", dotted(uid)),
        "00200013": ("IS", number.cast("string")),
        "00204000": ("LT", path),
        "00280002": ("US", F.lit("1")),
        "00280004": ("CS", F.lit("MONOCHROME1")),
        "00280100": ("US", F.lit("8")),
        "00280101": ("US", F.lit("8")),
        "00280103": ("US", F.lit("0")),
    }
    return F.create_map(*(x for tag, (kind, value) in entries.items() for x in (F.lit(tag), F.struct(F.lit(kind).alias("vr"), F.coalesce(value, F.lit("")).alias("value")))))
