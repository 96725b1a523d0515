"""An ever-growing seen-hash registry fed by a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.sessions import first_of_batch, only_new


def append_new(spark: SparkSession, registry_path: str):
    """A ``foreachBatch`` function: of each batch the first row of every unseen hash joins the registry.

    A batch is written under its own number, so a replayed batch replaces what it wrote before.
    """

    def handle(batch: DataFrame, number: int) -> None:
        try:
            registry = spark.read.parquet(registry_path).where(F.col("batch") < number)
        except Exception as e:  # the first batch finds no registry
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            registry = batch.select("digest", F.lit(-1).cast("long").alias("batch")).limit(0)
        only_new(first_of_batch(batch, "digest", "path"), "digest", registry, "digest").write.mode("overwrite").parquet(f"{registry_path}/batch={number}")

    return handle


def seen_hash_stream(spark: SparkSession, landing: str, schema, registry_path: str, checkpoint: str):
    """Starts the stream from a landing folder of parquet files into the registry."""
    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(append_new(spark, registry_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
