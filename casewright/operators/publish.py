"""Publication: payload plans, all-or-nothing commits, download and deletion plans."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from casewright.functions.uids import derived_uid
from casewright.operators.paths import build_path, conflicts, source_label
from casewright.operators.registry import orphans
from casewright.sources.file_heads import is_folder, listed
from casewright.sources.file_sink import write_files, zip_members
from casewright.sources.registry_json import backup_name, document_text
from casewright.sources.zip_members import members


def payload_plan(files: DataFrame, project: str) -> DataFrame:
    """One row per session and kind of file: where its zip goes and what it holds."""
    path = build_path(project=F.lit(project), subject=F.col("subject"), experiment=F.concat(F.lit("SOURCE_DATA-"), "subject"), scan=F.lit("0"), resource=F.lit("SRC"))
    return (
        files.where("is_valid")
        .groupBy("subject", "kind")
        .agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("new_name")).alias("names"))
        .select("subject", "kind", "n_files", F.array_join("names", ",").alias("names"), path.alias("archive_path"), F.concat(F.col("subject"), F.lit("-"), F.lower("kind"), F.lit(".zip")).alias("zip_name"))
    )


@F.pandas_udf(BinaryType())
def zipped(names: pd.Series, contents: pd.Series) -> pd.Series:
    """The files of one payload as zip bytes, dated alike so that equal input gives equal bytes."""

    def one(keys, blobs) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, b in sorted(zip(keys, blobs)):
                z.writestr(zipfile.ZipInfo(k), bytes(b))
        return out.getvalue()

    return pd.Series([one(k, b) for k, b in zip(names, contents)])


def note(user: Column, at: Column) -> Column:
    return F.concat(F.lit("BY: "), F.upper(user), F.lit("; AT: "), at)


class Commit:
    """Outputs are written beside their targets and renamed together; a failure leaves the targets as they were.

    A version folder is kept for each target that was there before, and is put back if a rename fails.  With
    ``whole`` all outputs go into one new folder of that name, which a single rename puts in place.
    """

    def __init__(self, spark: SparkSession, root: str, whole: str | None = None) -> None:
        self.spark, self.root, self.token, self.whole = spark, root.rstrip("/"), uuid.uuid4().hex, whole
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.names: list[str] = []

    def _at(self, *parts: str):
        return self._path("/".join((self.root, *parts)))

    def stage(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = (), form: str = "parquet") -> None:
        writer = df.write.mode("overwrite").format(form)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(self._staged(name))
        self._add(name)

    def stage_files(self, name: str, files: DataFrame) -> None:
        """``files(archive, name, content)`` as files and zips under ``name``."""
        write_files(files, self._staged(name))
        self._add(name)

    def _staged(self, name: str) -> str:
        return str(self._at("_staging", self.token, *([self.whole] if self.whole else []), name))

    def _add(self, name: str) -> None:
        if (self.whole or name) not in self.names:
            self.names.append(self.whole or name)

    def holds(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def __enter__(self) -> Commit:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        try:
            if kind is None:
                self._publish()
        finally:
            self._fs.delete(self._at("_staging", self.token), True)
        return False

    def _publish(self) -> None:
        done = []
        try:
            for name in self.names:
                old = self._at("_versions", self.token, name)
                moved = self._fs.exists(self._at(name))
                if moved:
                    self._fs.mkdirs(old.getParent())
                    self._rename(self._at(name), old)
                done.append((name, old if moved else None))
                self._fs.mkdirs(self._at(name).getParent())
                self._rename(self._at("_staging", self.token, name), self._at(name))
        except Exception:
            for name, old in reversed(done):
                self._fs.delete(self._at(name), True)
                if old is not None:
                    self._rename(old, self._at(name))
            raise

    def _rename(self, source, target) -> None:
        if not self._fs.rename(source, target):
            raise OSError(f"could not move {source} to {target}")


# --- sessions ----------------------------------------------------------------------------------------

PUBLICATIONS = "publications"


def _archive_path(project: str) -> Column:
    subject = F.col("subject")
    return build_path(project=F.lit(project), subject=subject, experiment=source_label(subject), scan=F.lit("0"), resource=F.lit("SRC"))


def _zip_name() -> Column:
    return F.concat(F.col("subject"), F.lit("-"), F.lower("media"), F.lit(".zip"))


def archive_targets(files: DataFrame, project: str) -> DataFrame:
    """Where a session's zips go: one row per subject and media."""
    subject, path, zip_name = F.col("subject"), _archive_path(project), _zip_name()
    return files.select("subject", "media").distinct().select("subject", source_label(subject).alias("experiment"), F.lit("0").alias("scan"), "media", path.alias("archive_path"), zip_name.alias("zip_name"))


def refuse(rows: DataFrame, message: str, *shown: str) -> None:
    """An error that names some of the rows, if there are any."""
    if found := rows.select(*shown).distinct().limit(3).collect():
        raise ValueError(f"{message}: " + ", ".join("/".join(str(v) for v in r) for r in found))


def published(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows of ``name`` (SUBJECTS, IMAGE_HASHES, TARGETS) over the publications under ``root``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{PUBLICATIONS}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{root}/{PUBLICATIONS}/*/{name}") if there else spark.createDataFrame([], schema)


_REGISTRY_ROW = "NAME string, UID string, CREATED_DATE_TIME string, CREATED_BY string"
SUBJECTS_ROW = f"{_REGISTRY_ROW}, ACQUISITION_SITE string, `GROUP` string"
HASHES_ROW = f"{_REGISTRY_ROW}, SUBJECT string, INSTANCE_NUM string"
TARGETS_ROW = "subject string, experiment string, scan string, media string, archive_path string, zip_name string"


def publish_sessions(files: DataFrame, root: str, project: str, user_uid: str, now: Column) -> str:
    """Publishes the sessions of ``files`` and the registry rows that belong to them; returns the publication's name.

    The files of a subject and media (DICOM, MP4) stream into one zip.  Subjects and image hashes get their registry rows.
    Zips, rows and the list of targets become visible by one rename, so a failed task leaves none of them.  Before
    anything is written these are refused: sessions of kind RF with an invalid file (of others the valid files go), sessions
    without a valid file, and targets of which the subject, the experiment or the scan is there already.
    """
    spark, own = files.sparkSession, files.select("subject", "kind", "media", "new_name", "digest", "instance_num", "is_valid", "site", "group", "content")
    refuse(own.where("kind = 'RF' AND NOT coalesce(is_valid, false)"), "sessions with invalid files", "subject")
    refuse(own.groupBy("subject").agg(F.bool_or(F.coalesce("is_valid", F.lit(False))).alias("any")).where("NOT any"), "sessions without a valid file", "subject")
    valid = own.where("is_valid")
    refuse(valid.groupBy("subject", "media", "new_name").agg(F.count("*").alias("n")).where("n > 1"), "files of one name", "subject", "new_name")
    targets = archive_targets(valid, project)
    there = published(spark, root, "TARGETS", TARGETS_ROW)
    for keys in (("subject",), ("subject", "experiment"), ("subject", "experiment", "scan")):
        refuse(conflicts(targets, there, *keys), f"the {keys[-1]} exists", *keys)
    stamp = (now.cast("string").alias("CREATED_DATE_TIME"), F.lit(user_uid).alias("CREATED_BY"))
    subjects = valid.groupBy("subject").agg(F.min("site").alias("ACQUISITION_SITE"), F.min("group").alias("GROUP"))
    images = valid.where("media <> 'MP4'").groupBy("digest").agg(F.min(F.struct("subject", "instance_num")).alias("at"))
    name = uuid.uuid4().hex
    with Commit(spark, root, f"{PUBLICATIONS}/{name}") as commit:
        commit.stage("SUBJECTS", subjects.select(F.col("subject").alias("NAME"), F.col("subject").alias("UID"), *stamp, "ACQUISITION_SITE", "GROUP"))
        commit.stage("IMAGE_HASHES", images.select(F.col("digest").alias("NAME"), derived_uid(F.col("digest")).alias("UID"), *stamp, F.col("at.subject").alias("SUBJECT"), F.col("at.instance_num").alias("INSTANCE_NUM")))
        commit.stage("TARGETS", targets)
        zip_path = F.concat(F.ltrim(_archive_path(project), F.lit("/")), F.lit("/"), _zip_name())
        commit.stage_files("files", valid.select(zip_path.alias("archive"), F.col("new_name").alias("name"), "content"))
    return name


def published_zips(spark: SparkSession, root: str) -> DataFrame:
    """Path and bytes of every published zip."""
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip")
    return zips.load(f"{root}/{PUBLICATIONS}").select("path", "content")


def published_members(spark: SparkSession, root: str) -> DataFrame:
    """``path, position, name, size, digest`` of the members of every published zip, which are read as streams.  Where only
    Spark's file systems lead, a zip is still one row."""
    folder = f"{root}/{PUBLICATIONS}"
    if is_folder(folder):
        return members(listed(spark, folder, ".zip").where(F.col("path").endswith(".zip")))
    return published_zips(spark, root).select("path", F.posexplode(zip_members(F.col("content"))).alias("position", "m")).select("path", F.col("position").cast("bigint").alias("position"), "m.*")


def download_plan(spark: SparkSession, root: str, subjects: DataFrame, target: str) -> DataFrame:
    """What to copy where for ``subjects(subject)``, in order: source, target and position within the subject."""
    wanted = published(spark, root, "TARGETS", TARGETS_ROW).join(subjects.select("subject").distinct(), "subject", "left_semi")
    order = F.row_number().over(Window.partitionBy("subject").orderBy("zip_name"))
    source = F.concat(F.lit(f"{root}/{PUBLICATIONS}/*/files"), F.col("archive_path"), F.lit("/"), F.col("zip_name"))
    return wanted.select("subject", order.alias("position"), source.alias("source"), F.concat(F.lit(f"{target}/"), F.col("subject"), F.lit("/"), F.col("zip_name")).alias("target"))


def write_form(forms: DataFrame, folder: str) -> None:
    """One JSON document per row of ``forms(name, value)``, under a folder per name.

    A name that is there already, or earlier among the rows, gets ``-copy`` before its extension.
    """
    spark = forms.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.schema("value string, name string").text(folder) if there else spark.createDataFrame([], "name string")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("value"))
    known = forms.select("name", "value", rank.alias("rank")).join(old.select("name", F.lit(True).alias("old")).distinct(), "name", "left")
    copied = F.regexp_replace("name", r"^(.*?)(\.[^.]*)?$", "$1-copy$2")
    named = known.withColumn("name", F.when((F.col("rank") > 1) | F.col("old"), copied).otherwise(F.col("name")))
    named.select("name", "value").write.mode("append").partitionBy("name").text(folder)


def form_names(forms: DataFrame, there: DataFrame) -> DataFrame:
    """``forms(name, value)`` with names that are free: one that ``there(name)`` has, or an earlier row, gets ``-copy``
    before its extension, and a number from the second copy on."""
    parts = [F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", i) for i in (1, 2)]
    stem = there.select(F.regexp_replace("name", r"-copy\d*(\.[^.]*)?$", "$1").alias("name")).groupBy("name").agg(F.count("*").alias("old"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("value")) - 1
    counted = forms.select("name", "value", rank.alias("rank")).join(stem, "name", "left")
    copy = F.col("rank") + F.coalesce("old", F.lit(0))
    suffix = F.concat(F.lit("-copy"), F.when(copy > 1, copy.cast("string")).otherwise(""))
    return counted.select(F.when(copy > 0, F.concat(parts[0], suffix, parts[1])).otherwise(F.col("name")).alias("name"), "value")


def write_forms(forms: DataFrame, folder: str, subject: str | None = None) -> None:
    """One file per form of ``forms(name, value)``, all or none, under free names; with ``subject``, the name of a column,
    in a folder of each subject."""
    spark = forms.sparkSession
    place = F.concat(F.col(subject), F.lit("/"), "name") if subject else F.col("name")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path") if exists else spark.createDataFrame([], "path string")
    below = 1 if subject is None else 2
    there = listed.select(F.array_join(F.slice(F.split("path", "/"), -below, below), "/").alias("name"))
    named = form_names(forms.select(place.alias("name"), "value"), there)
    write_files(named.select(F.lit(None).cast("string").alias("archive"), "name", F.col("value").cast("binary").alias("content")), folder)


def push_registries(tables: dict[str, DataFrame], root: str, stem: str, created_by: str, now: Column) -> str | None:
    """Puts the registry document in place of ``root/stem``; returns the backup's name, null for a first document.

    The backup is written and the tables are checked (every image hash belongs to a known subject) before the
    document changes; with an error neither stays.  The tables may have been read from the document itself.
    """
    spark = next(iter(tables.values())).sparkSession
    backup = None
    with Commit(spark, root) as commit:
        if commit.holds(stem):
            backup = "backups/" + spark.range(1).select(backup_name(stem, now)).first()[0]
            commit.stage(backup, spark.read.text(f"{root}/{stem}"), form="text")
        if {"IMAGE_HASHES", "SUBJECTS"} <= set(tables) and orphans(tables["IMAGE_HASHES"], "SUBJECT", tables["SUBJECTS"], "UID").limit(1).count():
            raise ValueError("image hashes of unknown subjects")
        commit.stage(stem, document_text(tables, created_by, now), form="text")
    return backup


def failure_row(spark: SparkSession, subject: str, step: str, message: str, at: Column) -> DataFrame:
    """What a failed publication leaves in the log."""
    return spark.createDataFrame([(subject, step, message)], "subject string, step string, message string").withColumn("at", at)


def log_failure(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_summary(lines: DataFrame, path: str) -> None:
    """The sorted report lines as one text file."""
    text = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("value"))
    text.write.mode("overwrite").text(path)
