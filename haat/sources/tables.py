"""Scan of the driver tables (S1).  Column pruning and filter pushdown are
left to Catalyst: callers select what they need and Spark narrows the
Parquet ``ReadSchema`` accordingly."""

from __future__ import annotations

import os
import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


_READS: dict[tuple, tuple] = {}


def snapshot_key(path: str) -> tuple | None:
    """Identity of local files at ``path`` (names, sizes, modification
    times); ``None`` for non-local paths, which are never memoised."""
    if "://" in path and not path.startswith("file:"):
        return None
    local = path[len("file:"):] if path.startswith("file:") else path
    try:
        if os.path.isdir(local):
            entries = sorted(os.scandir(local), key=lambda e: e.name)
            return (local,) + tuple((e.name, e.stat().st_size, e.stat().st_mtime_ns) for e in entries)
        st = os.stat(local)
        return (local, st.st_size, st.st_mtime_ns)
    except OSError:
        return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name`` under ``sf_dir``.  The DataFrame (schema from
    the Parquet footers) is reused within a session while the files are
    unchanged, which saves the listing and footer read on every query."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    snap = snapshot_key(path)
    if snap is None:
        return spark.read.parquet(path)
    key = (id(spark), snap)
    hit = _READS.get(key)
    if hit is not None and hit[0]() is spark:       # same live session, same files
        return hit[1]
    df = spark.read.parquet(path)
    _READS[key] = (weakref.ref(spark), df)
    return df
