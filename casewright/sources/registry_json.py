"""The registry document: one JSON file with metadata and tables, read and written by Spark."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.schemas import REGISTRY_COLUMNS, REGISTRY_EXTRAS, registry_schema
from casewright.sources.file_sink import file_system, write_rows
from casewright.sources.json_ranges import table_rows

_METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("CREATED", "LAST_MODIFIED", "CREATED_BY")]
    + [T.StructField("TABLE_EXTRA_COLUMNS", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
)


def document_schema(extras: dict[str, tuple[str, ...]]) -> T.StructType:
    tables = [T.StructField(n, T.ArrayType(registry_schema(*x))) for n, x in extras.items()]
    return T.StructType([T.StructField("metadata", _METADATA), T.StructField("tables", T.StructType(tables))])


def read_registries(spark: SparkSession, path: str, extras: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(metadata, table by name); extra columns absent from the file are null, absent tables empty.

    The rows are read by byte ranges, so a document may be of any size; where only Spark's readers reach the path, it is
    parsed as one JSON value.
    """
    extras = REGISTRY_EXTRAS if extras is None else extras
    document = spark.read.schema(document_schema(extras)).json(path, multiLine=True)
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()]  # one, or a few
    try:
        for name, _ in files:
            file_system(name)
    except (pa.ArrowInvalid, OSError):
        return document.select("metadata.*"), {n: document.select(F.explode(F.col("tables")[n]).alias("r")).select("r.*") for n in extras}
    rows = table_rows(spark, files)
    read = lambda n, x: rows.where(F.col("name") == n).select(F.from_json(F.col("row").cast("string"), registry_schema(*x)).alias("r")).select("r.*")
    return document.select("metadata.*"), {n: read(n, x) for n, x in extras.items()}


def document_text(tables: dict[str, DataFrame], created_by: str, now, created=None) -> DataFrame:
    """One row, ``value``: the whole document as valid JSON, nulls written as null."""
    extras = {n: [c for c in df.columns if c not in REGISTRY_COLUMNS] for n, df in tables.items()}
    parts = None
    for name, df in tables.items():
        row = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns))), {"ignoreNullFields": "false"}).alias(name))
        parts = row if parts is None else parts.crossJoin(row)  # one row each
    pairs = F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), F.col(n)) for n in tables))
    known = F.map_from_entries(F.array(*(F.struct(F.lit(n), F.array(*map(F.lit, x)).cast("array<string>")) for n, x in extras.items())))
    metadata = F.to_json(F.struct((created if created is not None else now).alias("CREATED"), now.alias("LAST_MODIFIED"), F.lit(created_by).alias("CREATED_BY"), known.alias("TABLE_EXTRA_COLUMNS")))
    return parts.select(F.concat(F.lit('{"metadata": '), metadata, F.lit(', "tables": {'), pairs, F.lit("}}")).alias("value"))


def write_registries(tables: dict[str, DataFrame], path: str, created_by: str, now) -> None:
    document_text(tables, created_by, now).coalesce(1).write.mode("overwrite").text(path)


def document_parts(tables: dict[str, DataFrame], created_by: str, now, created=None) -> DataFrame:
    """The document as rows ``table_no, kind, key, content`` that follow one another in the order of the first three.

    Kind 1 holds the rows of a table, 0 and 2 what stands before and after them.  Equal rows are one row here, repeated
    in its content, so exactly one row of a table is its first, which has no comma before it.
    """
    spark = next(iter(tables.values())).sparkSession
    extras = {n: [c for c in df.columns if c not in REGISTRY_COLUMNS] for n, df in tables.items()}
    known = F.map_from_entries(F.array(*(F.struct(F.lit(n), F.array(*map(F.lit, x)).cast("array<string>")) for n, x in extras.items())))
    metadata = F.to_json(F.struct((created if created is not None else now).alias("CREATED"), now.alias("LAST_MODIFIED"), F.lit(created_by).alias("CREATED_BY"), known.alias("TABLE_EXTRA_COLUMNS")))
    start = F.concat(F.lit('{"metadata": '), metadata, F.lit(', "tables": {'))
    frame = lambda no, kind, content: spark.range(1).select(F.lit(no).alias("table_no"), F.lit(kind).alias("kind"), F.array().cast("array<string>").alias("key"), content.alias("content"))
    out = []
    for no, (name, df) in enumerate(tables.items()):
        # Nulls sort before the empty text, as they do among structs.
        key = F.array(*(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("")) for c in df.columns))
        rows = df.groupBy(*df.columns).agg(F.count("*").alias("#n")).select(key.alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"), "#n")
        first = rows.agg(F.min("key").alias("#first"))  # one row
        text = F.array_join(F.array_repeat("json", F.col("#n").cast("int")), ",")
        body = rows.crossJoin(F.broadcast(first)).select(F.lit(no).alias("table_no"), F.lit(1).alias("kind"), "key", F.concat(F.when(F.col("key") == F.col("#first"), "").otherwise(","), text).alias("content"))
        before = F.concat(start if no == 0 else F.lit(", "), F.lit(f'"{name}": ['))
        out += [frame(no, 0, before), body, frame(no, 2, F.lit("]}}" if no == len(tables) - 1 else "]"))]
    return reduce(DataFrame.unionByName, out)


def write_document(tables: dict[str, DataFrame], path: str, created_by: str, now, created=None, partitions: int | None = None) -> None:
    """The document as one file, byte for byte that of ``document_text``, with no table in one row or task.

    The rows are sorted over ranges, each task writes its range as a part, and the parts are put behind one
    another as streams.  A failure leaves no file.
    """
    parts = document_parts(tables, created_by, now, created)
    spark = parts.sparkSession
    order = ("table_no", "kind", "key")
    dealt = parts.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    named = dealt.select(F.lit(None).cast("string").alias("archive"), F.format_string("part-%06d", F.spark_partition_id()).alias("name"), F.lit(1).alias("part"), F.col("content").cast("binary").alias("content"))
    folder = f"{path}-parts-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(conf)
    try:
        write_rows(named, folder)
        sink = files.create(at(f"{folder}/whole"), True)
        try:
            for found in sorted(x.getPath().toString() for x in files.listStatus(at(folder)) if x.getPath().getName().startswith("part-")):
                source = files.open(at(found))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, conf, False)
                source.close()
        finally:
            sink.close()
        files.delete(at(path), True)
        if not files.rename(at(f"{folder}/whole"), at(path)):
            raise OSError(f"could not move the document to {path}")
    finally:
        files.delete(at(folder), True)


def backup_name(stem: str, now) -> object:
    """``<stem>-backup-YYYY_MM_DD_HH_MM_SS.json``."""
    return F.concat(F.lit(f"{stem}-backup-"), F.date_format(now, "yyyy_MM_dd_HH_mm_ss"), F.lit(".json"))
