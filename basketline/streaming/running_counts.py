"""Purchases per (category, user), kept up to date as new files arrive.

Each run takes only files that no earlier run has taken; the checkpoint remembers
them, so a stopped or failed run goes on where it was.

The sink has two parts. ``changes/batch_id=<n>`` holds the totals that batch n changed, and
``base/upto=<n>`` all totals as of batch n. Reading takes the newest base and the changes
of later batches, so a batch that is repeated after a compaction changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from basketline.sources import tables

#: State has one row per (category, user) and never expires: keep it off the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Files that one batch takes, so that a backlog is worked off in pieces.
FILES_PER_BATCH = 1_000


def running_user_counts(events: DataFrame) -> DataFrame:
    """The streaming form of ``counting.user_counts``."""
    return (
        events.where(F.col("user_id").isNotNull())
        .groupBy("category", "user_id")
        .agg(F.count(F.lit(1)).alias("num_purchases"))
    )


def update_user_counts(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    max_files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Count all new JSON files in ``source`` and stop.

    Changed counts are running totals. Each batch writes its own folder and replaces
    it when the batch is repeated.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_batch)
    counts = running_user_counts(reader.json(source))

    def replace_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/changes/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace_batch)
        .start()
    )


def _part(spark: SparkSession, sink: str, name: str, number: str) -> DataFrame | None:
    """Totals with the batch they are from, of one part of the sink if it exists."""
    path = f"{sink}/{name}"
    if not tables.exists(spark, path):
        return None
    schema = StructType.fromDDL(f"category string, user_id string, num_purchases long, {number} long")
    return spark.read.schema(schema).parquet(path).withColumnRenamed(number, "batch_id")


def _current(spark: SparkSession, sink: str) -> DataFrame:
    """The newest base and all later changes: (category, user_id, num_purchases, batch_id)."""
    base, changes = _part(spark, sink, "base", "upto"), _part(spark, sink, "changes", "batch_id")
    if base is None:
        return changes
    # Batch numbers are folder names, so this reads no rows.
    upto = base.agg(F.max("batch_id")).first()[0]
    return base.where(F.col("batch_id") == upto).unionByName(changes.where(F.col("batch_id") > upto))


def latest_user_counts(spark: SparkSession, sink: str) -> DataFrame:
    """Current totals: per key, the value of the last batch that changed it."""
    return _current(spark, sink).groupBy("category", "user_id").agg(
        F.max_by("num_purchases", "batch_id").alias("num_purchases")
    )


def compact_user_counts(spark: SparkSession, sink: str) -> None:
    """Write the current totals as a new base, so that reading need not take all batches.

    Meant to run between updates, on a schedule. Older folders may be deleted afterwards.
    """
    last = _current(spark, sink).agg(F.max("batch_id")).first()[0]
    if not tables.exists(spark, f"{sink}/base/upto={last}"):
        latest_user_counts(spark, sink).write.mode("overwrite").parquet(f"{sink}/base/upto={last}")
