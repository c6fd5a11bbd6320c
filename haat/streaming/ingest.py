"""Shared pieces of the streaming ingestion: a file stream over one table's
Parquet files and an idempotent append sink.

Sink contract: every micro-batch's updated rows are appended together with
the batch id.  A batch replayed after a failure carries the same id, and
readers keep the newest row per key, so replays change nothing.

Event time is the ``ts`` column cast to ``timestamp``; run the streams with
``spark.sql.session.timeZone=UTC`` (``haat.get_spark`` sets it) so window
boundaries fall on UTC midnight like the batch operators'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, source_dir: str, file_glob: str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the Parquet files matching ``file_glob``."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(source_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def start_append(stream: DataFrame, project: Callable[[DataFrame], DataFrame], table_path: str,
                 checkpoint_path: str, available_now: bool = True):
    """Run ``stream`` in update mode; each batch is projected and appended
    with its ``batch_id``."""
    def append_batch(batch: DataFrame, batch_id: int) -> None:
        (project(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("append").parquet(table_path))

    w = (stream.writeStream.outputMode("update").foreachBatch(append_batch)
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_latest(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    """The newest appended row per key (highest ``batch_id``)."""
    t = spark.read.parquet(table_path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return t.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r", "batch_id")
