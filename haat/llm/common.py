"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
import os
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haat.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where
    that is unset (tests, one machine) a folder in the warehouse."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per context, for the
    operators that run Python in tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_haat_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = Path(SparkFiles.getRootDirectory(), "source")
    folder.mkdir(exist_ok=True)
    with zipfile.ZipFile(folder / "haat.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(folder / "haat.zip"))
    sc._haat_shipped = True


# What a Python worker keeps between the tasks of one kind (such as tables of
# token ids), by kind.
KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    return KEPT.setdefault(kind, {})


def _begin(kind: str) -> None:
    for other in set(KEPT) - {kind}:
        del KEPT[other]


def _end() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def task(run: Callable, kind: str = "") -> Callable:
    """``run`` for mapInArrow or mapInPandas.  Spark uses Python workers again
    for later stages, and they wait beside the executor's JVM meanwhile: so a
    task begins by dropping what tasks of another kind kept, and ends by
    giving free memory back to the system."""
    def whole(batches):
        _begin(kind)
        try:
            yield from run(batches)
        finally:
            _end()
    return whole


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from that copy, so
    that a lost executor costs no recomputation of what lies before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Where id_bucket looks at the ids' distribution: every 64th, and tails halved down to 1/8192.
_TAIL = [2.0 ** -k for k in range(13, 6, -1)]
SHARES = _TAIL + [i / 64 for i in range(1, 64)] + [1 - t for t in reversed(_TAIL)]


def id_bucket(df: DataFrame, col: str, rows_per_bucket: int) -> Column:
    """A bucket number that grows with ``col`` and holds about
    ``rows_per_bucket`` rows; nulls make bucket -1.

    The ids between two of at most 78 quantiles are cut into buckets of equal
    width, as many as the rows there ask for, so ids far from all others cost
    the evenness of their own segment only.  One aggregate job over one
    column; the quantiles are approximate, which moves borders, never a rank.
    """
    lo, hi, n, found = df.agg(F.min(col), F.max(col), F.count(col),
                              F.percentile_approx(col, SHARES, 1 << 15)).first()
    if lo is None:
        return F.lit(-1).cast("long")
    first: dict = {lo: 0.0}                      # where a segment begins: the share of rows before it
    for share, edge in zip(SHARES, found):
        first.setdefault(edge, share)
    edges = sorted(first)
    segments, base = [], 0
    for edge, after in zip(edges, edges[1:] + [hi + 1]):
        rows = n * (first.get(after, 1.0) - first[edge])
        parts = max(1, math.ceil(rows / rows_per_bucket))
        width = -((edge - after) // parts)
        segments.append(f"named_struct('e', {edge}bd, 'w', {width}bd, 'b', {base}L)")
        base += -((edge - after) // width)
    i = F.col(col).cast("decimal(20,0)")
    at = F.greatest(F.size(F.filter(F.expr(f"array({', '.join(f'{e}bd' for e in edges)})"), lambda e: e <= i)), F.lit(1))
    chosen = F.array(F.element_at(F.expr(f"array({', '.join(segments)})"), at))
    bucket = F.element_at(F.transform(chosen, lambda s: s.b + F.floor((i - s.e) / s.w).cast("long")), 1)
    return F.when(F.col(col).isNull(), F.lit(-1).cast("long")).otherwise(bucket)


def ranked(df: DataFrame, part: str, order: str, out: str, tie: Column | None = None,
           slim: DataFrame | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """``df`` with ``out`` = 0-based position of the row in its ``part`` (not
    null), by the integer column ``order`` (nulls first).

    Rows are counted in buckets of the order column first, so that a ``part``
    with a third of all rows is ranked by many tasks; a prefix sum over the
    bucket counts makes the local ranks global.  ``slim``, rows of ``df`` with
    no more than those two columns, is what the counts are read from; whole
    rows are shuffled once.
    """
    slim = df if slim is None else slim
    bucket = id_bucket(slim, order, rows_per_bucket)
    before = Window.partitionBy("_op").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.groupBy(F.col(part).alias("_op"), bucket.alias("_ob")).agg(F.count(F.lit(1)).alias("_n")) \
        .select("_op", "_ob", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(part, "_b").orderBy(F.col(order).asc_nulls_first(), *([] if tie is None else [tie]))
    ranks = df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(local))
    joined = ranks.join(offsets, (F.col(part) == F.col("_op")) & (F.col("_b") == F.col("_ob")))
    return joined.withColumn(out, F.col("_off") + F.col("_r") - 1).drop("_b", "_op", "_ob", "_off", "_r")


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of ``df``, whatever their names, but for those named."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]
