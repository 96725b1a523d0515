"""New hashes of a stream by keyed state: what a batch costs depends on the batch, not on what was seen before.

Every hash has a state of its own, which says that it was seen.  States live in a RocksDB store (``STATE_STORE``) beside the
stream's checkpoint, so a batch looks up its own hashes only; the registry is never read again.  Of each batch the row
with the least path of every unseen hash comes out.  Hashes that a registry holds already enter as rows of a second
source that set the state and give nothing.

The sink writes each batch once, by its own log; after a failure the batch is run again from the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The settings under which states are kept on disk and looked up one by one.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_SEEN = "seen boolean"


def first_unseen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The row with the least path of a hash that has no state yet, unless the registry brings the hash itself."""
    best, known = None, state.exists
    for rows in batches:
        known = known or bool(rows["known"].any())
        if not known:
            path = rows["path"].fillna("").min()
            best = path if best is None else min(best, path)
    if not state.exists:
        state.update((True,))
        if not known:
            yield pd.DataFrame({"digest": [key[0]], "path": [best]})


def new_hashes(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``digest, path`` of the hashes of the stream ``files(digest, path)`` that neither it nor the stream ``known(digest)`` had.

    Rows without a hash are left out.
    """
    rows = files.select("digest", "path", F.lit(False).alias("known"))
    if known is not None:
        rows = rows.unionByName(known.select("digest", F.lit(None).cast("string").alias("path"), F.lit(True).alias("known")))
    keyed = rows.where(F.col("digest").isNotNull()).groupBy("digest")
    return keyed.applyInPandasWithState(first_unseen, "digest string, path string", _SEEN, "append", GroupStateTimeout.NoTimeout)


def new_hash_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, registry: str | None = None) -> StreamingQuery:
    """Starts the stream from parquet files (digest, path) in ``landing``, and hashes (NAME) in ``registry``, into ``out``."""
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    files = spark.readStream.schema("digest string, path string").parquet(landing)
    known = spark.readStream.schema("NAME string").parquet(registry).select(F.col("NAME").alias("digest")) if registry else None
    stream = new_hashes(files, known).writeStream.format("parquet").option("path", out)
    return stream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
