"""Incremental search-interest ingestion (M15/S12 as a stream).

The reference appends a fresh interest series to its ``trends`` table each
time ingestion runs.  Here new ``events`` files are picked up by a file
stream; a one-day tumbling window counts events per type, and
every micro-batch's updated counts are appended to a Parquet table together
with the batch id.  Readers keep the newest count per (date, product), so a
batch that is replayed after a failure (same id) changes nothing.

State is one counter per (type, day): the calendar bounds it, so it needs no
watermark, and events that arrive late are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd, safe_div
from haat.streaming.ingest import file_stream, read_latest, start_append


def event_counts_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming daily counts per event type from Parquet files in ``source_dir``."""
    ev = file_stream(spark, source_dir, file_glob, max_files_per_trigger).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type"))
    return (ev.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("product"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def start_ingest(counts: DataFrame, table_path: str, checkpoint_path: str, available_now: bool = True):
    """Run the stream into ``table_path`` (update mode, one append per batch)."""
    return start_append(
        counts, lambda b: b.select(F.col("w.start").cast("date").alias("date"), "product", "n_events"),
        table_path, checkpoint_path, available_now)


def read_counts(spark: SparkSession, table_path: str) -> DataFrame:
    """Newest count per (date, product) across all appended batches."""
    return read_latest(spark, table_path, ["date", "product"])


def interest_from_counts(counts: DataFrame) -> DataFrame:
    """M15 on the ingested counts: each type's peak day = 100."""
    peak = F.max("n_events").over(Window.partitionBy("product"))
    return counts.select("product", "date", "n_events",
                         rnd(safe_div(F.col("n_events") * 100, peak)).alias("interest"))
