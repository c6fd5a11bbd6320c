"""SparkSession construction and the shared scratch location."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings that matter for correctness (time zone) and for scale (AQE,
# skew handling, runtime filters).  Everything else is left to the cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Target ~128 MB per post-shuffle partition; AQE coalesces small ones and
    # splits skewed ones, so the static shuffle.partitions only sets the ceiling.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "haat", extra: dict | None = None) -> SparkSession:
    """Return a session with the library defaults applied.

    On a cluster ``master`` stays ``None`` and the launcher decides; tests and
    the bench pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh, not yet existing folder that all executors share: under the
    session's checkpoint folder, or where none is set under its warehouse."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "scratch")
    return os.path.join(base.rstrip("/"), f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}")
