"""SparkSession factory with the settings that the engine's semantics rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC sessions make timestamps compare equal across engines; LAST_WIN gives maps dict semantics.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "casewright", **conf: str) -> SparkSession:
    """A session with SETTINGS; ``conf`` (dots as double underscores) overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_ROWS`` rows to and from Python where the session leaves the default of ten thousand:
    rows here are whole texts or files, and a batch stands in memory on both sides, several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what one run writes, in the folder that all executors share; it goes when the interpreter ends."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="casewright-")
        spark.conf.set("spark.checkpoint.dir", shared)
    if not _scratch:
        atexit.register(_clear_scratch)
    _scratch.append((spark, f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"))
    return _scratch[-1][1]


def kept_in(folder: str):
    """A function that writes a result below ``folder`` and reads it back, which cuts its lineage."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


_scratch: list[tuple[SparkSession, str]] = []


def _clear_scratch() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary by contract
            return


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package where they would not find it by their own path."""
    root = Path(__file__).resolve().parent.parent
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if context.applicationId in _shipped or any(p and Path(p).resolve() == root for p in reachable):
        return
    archive = Path(tempfile.mkdtemp(prefix="casewright-")) / "casewright.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "casewright").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
