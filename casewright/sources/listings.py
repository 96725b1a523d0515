"""File listings by tasks, or through Spark's binary source; listing queries never read the bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.text import extension
from casewright.operators.positions import numbered
from casewright.sources.file_heads import file_heads, is_folder, listed


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def _listed(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """Files without their bytes, with one of these suffixes in any case, or all.

    Tasks list the folders, so the driver holds no file of theirs.  Where only Spark's file systems lead, and for a pattern
    of paths, the driver lists them; that source reckons each file as four megabytes to open and deals a task some thirty,
    but none is opened, so a few tasks a core hold them all.
    """
    found = listed(spark, folder, ",".join(suffixes)) if is_folder(folder) else _files(spark, folder).select("path", "modificationTime", "length")
    held = found.where(F.lower(extension(F.col("path"))).isin(*suffixes)) if suffixes else found
    return held.coalesce(4 * spark.sparkContext.defaultParallelism)


def dicom_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Files with the suffix .dcm in any case, or with none."""
    columns = ["path", "modificationTime", "length"] + ["content"] * content
    found = _files(spark, folder) if content else _listed(spark, folder)
    return found.where(F.lower(extension(F.col("path"))).isin(".dcm", "")).select(*columns)


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """JPG images in order of time, then MP4 videos; ``position`` numbers them from 1 on.

    The time is that of the last change, the only one that Spark's file systems give.
    """
    kind = F.when(F.lower(extension(F.col("path"))) == ".mp4", "MP4").otherwise("JPG")
    found = _listed(spark, folder, ".jpg", ".jpeg", ".mp4").select("path", "modificationTime", "length", kind.alias("type"))
    day = F.concat_ws("|", "type", F.date_format("modificationTime", "yyyy-MM-dd"))
    return numbered(found, "position", day, "type", "modificationTime", "path").orderBy("type", "modificationTime", "path")


def at_least_one(files: DataFrame, kind: str) -> DataFrame:
    """The listing, or an error if no file of ``kind`` (JPG, MP4) is in it."""
    if files.where(F.col("type") == kind).isEmpty():
        raise FileNotFoundError(f"no {kind} file")
    return files


def playable_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Videos with whether their container header can be read; only the first bytes of a file are fetched."""
    return file_heads(spark, folder, ".mp4", 12).select("path", (F.decode(F.substring("head", 5, 4), "ISO-8859-1") == "ftyp").alias("is_valid"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images: origin, height, width, nChannels, data; ``is_valid`` is false for one that cannot be read.

    The source deals a task some thirty images (see ``_listed``); a few tasks a core take them one after another.
    """
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(folder)
    read = read.coalesce(4 * spark.sparkContext.defaultParallelism)
    return read.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").withColumn("is_valid", F.col("height") > 0)
