"""Shared helpers: table access, staged tables in the shared folder, token hashing, crc folds."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import ship_package, short_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table, so that extra columns never clash with ours."""
    ship_package(spark)
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def lower_ascii(text: str) -> str:
    return text.translate(_LOWER)


def fold(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % buckets


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode where the session names none."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="casewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The folder goes when the interpreter ends or by ``release``.
    """
    spark = df.sparkSession
    short_batches(spark)
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(release)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the staged table behind ``df`` once nothing reads it any more."""
    for item in list(_staged):
        if any(item[1].split("/")[-1] in f for f in df.inputFiles()[:1]):
            _remove(*item)
            _staged.remove(item)


def release() -> None:
    """Delete every staged table of this process."""
    while _staged:
        _remove(*_staged.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the context may be gone at exit; the folder is temporary by contract
        return


# --- token hashing over whole batches -------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers(n: int, base: np.uint64 = _POWER) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    global _powers
    if base != _POWER:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base)]))[:n]
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base)]))
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PIECE = 1 << 17  # some ten arrays of eight bytes a byte stand in memory for one piece
_ALNUM = np.ones(256, bool)
_ALNUM[:128] = [chr(c).isalnum() for c in range(128)]


def word_hashes(texts: list[str], alnum: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lowered unless ``fold`` is off, in text order, and the number of
    words per text.

    Words are split at ASCII white space, or with ``alnum`` at every ASCII byte that is neither letter
    nor digit.  The buffer is worked through in pieces cut between words, so memory stays bounded
    by the text itself however long a document is.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    word_byte, values = _ALNUM if alnum else ~_SPACE, _FOLDED if fold else _BYTE
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + _PIECE)
        while end < len(buf) and word_byte[buf[end]]:
            cut = np.flatnonzero(~word_byte[buf[end : end + _PIECE]])
            end = end + int(cut[0]) if len(cut) else min(len(buf), end + _PIECE)
        part = buf[at:end]
        inside = word_byte[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = np.flatnonzero(begins)
        if len(first):
            origin = np.zeros(len(part), np.int64)
            origin[first] = first
            place = np.arange(len(part)) - np.maximum.accumulate(origin)
            value = np.where(inside, values[part] * powers(int(place.max()) + 1)[place], np.uint64(0))
            hashes.append(mix(np.add.reduceat(value, first)))
            starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(begin, np.cumsum(sizes + 1)), prepend=0)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word between ASCII white space."""
    edge = np.diff(np.concatenate([[0], (~_SPACE[np.frombuffer(raw, np.uint8)]).astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def slices(texts: list[str], limit: int = 1 << 22):
    """Index ranges of consecutive texts of about ``limit`` code points together, one text at least."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def environment_path() -> str:
    """Where the public tokenizer vocabularies lie; a parameter of every operator that uses one."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
