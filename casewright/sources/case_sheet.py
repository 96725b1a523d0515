"""A Python data source for batch sheets in the zipped XML workbook format, by the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from casewright.functions.text import normalise_header
from casewright.sources.file_sink import file_system, write_rows

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def read_rows(path: str) -> Iterator[list[str]]:
    """Rows of the first sheet as strings, blanks as ''."""
    system, at_path = file_system(path)
    with system.open_input_file(at_path) as file, zipfile.ZipFile(file) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        first = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        with book.open(first) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                values: list[str] = []
                for cell in row.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(values)
                    values += [""] * (at + 1 - len(values))
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        values[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        values[at] = shared[int(value.text)] if kind == "s" else value.text
                yield values
                row.clear()


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType) -> None:
        self.paths, self.names = paths, schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = read_rows(partition.value)
        header = [normalise_header(h) for h in next(rows, [])]
        at = [header.index(n) if n in header else None for n in self.names]
        for row in rows:
            if any(row):
                yield tuple("" if i is None or i >= len(row) else row[i] for i in at)


class CaseSheetSource(DataSource):
    """``spark.dataSource.register(CaseSheetSource); spark.read.format("case_sheet").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "case_sheet"

    def schema(self) -> StructType:
        header = next(read_rows(self.options["path"].split(",")[0]), [])
        return StructType([StructField(normalise_header(h), StringType()) for h in header if h.strip()])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"].split(","), schema)


_SHEET = "xl/worksheets/sheet1.xml"


def _row_xml(values: list[Column]) -> Column:
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = (x for c in values for x in (F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), escaped(c), F.lit("</t></is></c>")))
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def write_sheets(rows: DataFrame, book: str, order: str, folder: str) -> None:
    """One workbook per value of the column ``book`` (its file name), with the other columns but ``order`` as text, in order.

    Rows stream into their workbook one by one; blanks and nulls come back as ``''``.
    """
    names = [c for c in rows.columns if c not in (book, order)]
    line = F.row_number().over(Window.partitionBy(book).orderBy(order)).alias("part")
    body = rows.select(F.col(book).alias("archive"), line, _row_xml([F.col(f"`{c}`") for c in names]).alias("text"))
    start = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    books = rows.select(F.col(book).alias("archive")).distinct()
    head = books.select("archive", F.lit(0).alias("part"), F.concat(F.lit(start), _row_xml([F.lit(n) for n in names])).alias("text"))
    tail = books.select("archive", F.lit(2**31 - 1).alias("part"), F.lit("</sheetData></worksheet>").alias("text"))
    parts = head.unionByName(body).unionByName(tail).select("archive", F.lit(_SHEET).alias("name"), "part", F.col("text").cast("binary").alias("content"))
    write_rows(parts.repartition("archive").sortWithinPartitions("archive", "part"), folder)
