"""Incremental weekly sentiment ingestion (S13 as a stream).

Each event contributes its clamped score to the Monday-based week that
contains it (7-day windows shifted by 4 days from the Thursday epoch);
sums and counts are kept as state per (week, product), without a watermark, so
late events count too, and every batch's updated weeks are appended
(``ingest.start_append``).  The week label is its Sunday, as in the batch
``operators.sentiment.weekly_sentiment``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haat.functions.numeric import clamp, rnd
from haat.streaming.ingest import file_stream, read_latest, start_append


def weekly_sentiment_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                            max_files_per_trigger: int | None = None) -> DataFrame:
    ev = file_stream(spark, source_dir, file_glob, max_files_per_trigger).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("product"),
        clamp(F.col("value") / 100.0, 0.35, 0.95).alias("sentiment"))
    return (ev.groupBy(F.window("ts", "7 days", startTime="4 days").alias("w"), "product")
            .agg(F.sum("sentiment").alias("s_sum"), F.count(F.lit(1)).alias("n")))


def _project(batch: DataFrame) -> DataFrame:
    return batch.select(F.date_add(F.col("w.start").cast("date"), 6).alias("week"),
                        "product", "s_sum", "n")


def start_weekly_ingest(stream: DataFrame, table_path: str, checkpoint_path: str,
                        available_now: bool = True):
    return start_append(stream, _project, table_path, checkpoint_path, available_now)


def read_weekly(spark: SparkSession, table_path: str) -> DataFrame:
    """``week, product, sentiment, n_scores`` from the ingested table."""
    t = read_latest(spark, table_path, ["week", "product"])
    return t.select("week", "product", rnd(F.col("s_sum") / F.col("n"), 4).alias("sentiment"),
                    F.col("n").alias("n_scores"))
