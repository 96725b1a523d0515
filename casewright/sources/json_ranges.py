"""The rows of one large JSON document, read by byte ranges.

A document ``{..., "tables": {name: [row, ...], ...}}`` of any size and layout is dealt in ranges of ``CHUNK`` bytes.  What a
byte means depends only on whether it stands inside a string and on how many brackets are open, so three passes do:

1. Every range tells whether it holds an odd number of quotes, and how it changes the depth if it begins outside and
   if it begins inside a string.  These three numbers a range give the state in which every range begins.
2. Every range tells the objects and arrays that begin the document's sections, with their keys: a few rows.
3. Every range gives the objects that begin in it as text, reading on to the end of the last.

No task holds more than a range and one row.  Members of a table that are no objects are no rows; of a document that does
not close there are none.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casewright.sources.file_sink import file_system

CHUNK, LOOK = 1 << 22, 1 << 16
_ESCAPE, _KEY = re.compile(rb"\\.", re.S), re.compile(rb'"([^"]*)"\s*:\s*$')
_RANGE = "file int, path string, start bigint, stop bigint, length bigint, inside int, depth int"


def _plain(f, raw: bytes, start: int) -> bytes:
    """``raw``, read at ``start``, with every escape as two underscores, so that each quote left begins or ends a string."""
    run, at = 0, start
    while at > 0:
        tail = f.read_at(min(at, LOOK), at - min(at, LOOK))
        here = len(tail) - len(tail.rstrip(b"\\"))
        run, at = run + here, at - len(tail)
        if here < len(tail):
            break
    return _ESCAPE.sub(b"__", b"_" + raw[1:] if run % 2 and raw else raw)


def _changes(plain: bytes, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and by how much each changes the depth."""
    a = np.frombuffer(plain, np.uint8)
    outside = (np.cumsum(a == 34, dtype=np.int32) + inside) % 2 == 0
    change = ((a == 123) | (a == 91)).astype(np.int32) - ((a == 125) | (a == 93))
    return a, change * outside


def _over(ranges: DataFrame, schema: str, one) -> DataFrame:
    """What ``one(f, range)`` yields (tuples of columns) for every range."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                system, path = file_system(r["path"])
                with system.open_input_file(path) as f:
                    columns = one(f, r)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))

    return ranges.mapInArrow(run, schema)


def _effect(f, r: dict) -> tuple:
    plain = _plain(f, f.read_at(r["stop"] - r["start"], r["start"]), r["start"])
    return [r["file"]], [r["start"]], [plain.count(b'"') % 2], *([int(_changes(plain, k)[1].sum())] for k in (0, 1))


def _sections(f, r: dict) -> tuple:
    base = max(0, r["start"] - LOOK)
    raw = f.read_at(r["stop"] - base, base)
    plain = _plain(f, raw, base)
    a, change = _changes(plain[r["start"] - base :], r["inside"])
    depth = r["depth"] + np.cumsum(change, dtype=np.int32)
    found = np.flatnonzero((change == 1) & (((a == 123) & (depth == 2)) | ((a == 91) & (depth == 3))))
    keys = []
    for at in (found + r["start"] - base).tolist():
        m = _KEY.search(plain, max(0, at - LOOK), at)
        keys.append(json.loads(raw[m.start() : m.end(1) + 1]) if m else None)
    return [r["file"]] * len(found), (found + r["start"]).tolist(), depth[found].tolist(), keys


def _row_reader(sections: dict[int, tuple[np.ndarray, list]]):
    def rows(f, r: dict) -> tuple:
        begins, tables = sections[r["file"]]
        more = 0
        while True:
            raw = f.read_at(min(r["length"], r["stop"] + more) - r["start"], r["start"])
            a, change = _changes(_plain(f, raw, r["start"]), r["inside"])
            depth = r["depth"] + np.cumsum(change, dtype=np.int32)
            opens = np.flatnonzero((a == 123) & (change == 1) & (depth == 4))
            opens = opens[opens < r["stop"] - r["start"]]
            closes = np.flatnonzero((a == 125) & (change == -1) & (depth == 3))
            if not len(opens) or (len(closes) and closes[-1] > opens[-1]):
                break
            more = max(LOOK, 2 * more)
        ends = closes[np.searchsorted(closes, opens)] if len(opens) else opens
        names = [tables[i] if i >= 0 else None for i in (np.searchsorted(begins, opens + r["start"], "right") - 1).tolist()]
        kept = [(n, raw[x : y + 1]) for n, x, y in zip(names, opens.tolist(), ends.tolist()) if n is not None]
        return [n for n, _ in kept], [x for _, x in kept]

    return rows


def table_rows(spark: SparkSession, files: list[tuple[str, int]], chunk: int = CHUNK) -> DataFrame:
    """``name, row`` (JSON text) of every row of the tables in the documents ``files(path, length)``."""
    ranges = [(k, path, at, min(length, at + chunk), length, 0, 0) for k, (path, length) in enumerate(files) for at in range(0, length, chunk)]
    effects = {(e.file, e.start): e for e in _over(spark.createDataFrame(ranges, _RANGE), "file int, start bigint, odd int, outside int, inside int", _effect).collect()}
    placed, open_, now = [], {}, (-1, 0, 0)
    for k, path, start, stop, length, _, _ in ranges:  # one row for each range of four megabytes
        file, inside, depth = now if now[0] == k else (k, 0, 0)
        placed.append((k, path, start, stop, length, inside, depth))
        e = effects[k, start]
        now = k, inside ^ e.odd, depth + (e.inside if inside else e.outside)
        open_[k] = now[1:] != (0, 0)
    whole = spark.createDataFrame([x for x in placed if not open_[x[0]]], _RANGE)
    found = sorted(_over(whole, "file int, start bigint, depth int, key string", _sections).collect(), key=lambda e: (e.file, e.start))
    sections: dict[int, tuple[list, list]] = {k: ([], []) for k in range(len(files))}
    top = {}
    for e in found:
        if e.depth == 2:
            top[e.file] = e.key
        sections[e.file][0].append(e.start)
        sections[e.file][1].append(e.key if e.depth == 3 and top.get(e.file) == "tables" else None)
    held = {k: (np.array(x, np.int64), n) for k, (x, n) in sections.items()}
    return _over(whole, "name string, row binary", _row_reader(held))
