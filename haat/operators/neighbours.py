"""Exact nearest neighbours of every stored vector (M10 for many queries).

The reference fills a flat L2 index; asking it for the neighbours of all it
holds compares everything with everything.  Here the vectors are dealt into an
inverted list of balls: a bounded number of centres, each vector with the
nearest one, and the lists are written as partitions.  A list is kept in
blocks of bounded size; a block knows its centre and the least and greatest
distance from it.

* Round 1: every vector is searched in its own block.  Its k-th distance there
  is an upper bound for the whole table.
* Round 2: by the triangle inequality a block of centre c with distances from
  ``near`` to ``far`` can hold something within t of q only if
  ``near - t <= |q - c| <= far + t``.  Only blocks for which that holds are
  probed; for all others the inequality certifies that nothing is missed.

A block's vectors are read once, by one task, and the probes stream past
them: nothing is copied per query, and memory is one block and one batch.  The
centres (at most ``max_centres``) and the blocks' bounds are the only things
that every task holds; the bounds grow as rows / ``block_rows`` and are sent
only while they stay under ``max_blocks`` (blocks grow beyond that).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd
from haat.session import scratch_dir

SLACK = 1e-9        # relative, on bounds computed in floating point
CELLS = 1 << 20     # of a matrix that a task fills at once
SENT = 2048         # vectors handed on at once


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows, differences first, so that equal vectors
    are at exactly 0 and equal pairs at equal distances."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        d = a[i:i + 64, None, :] - b
        out[i:i + 64] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by one matrix product: good to about 1e-7 of the lengths."""
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1) - 2 * a @ b.T, 0))


def _far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it."""
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _best(q: pd.DataFrame, block: pd.DataFrame, bm: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best of the block that have another id."""
    qm = _matrix(q["v"])
    ids, rows = block["vec_id"].to_numpy(), []
    rough = _rough(qm, bm)
    rough[q["vec_id"].to_numpy()[:, None] == ids] = np.inf
    error = 1e-6 * (np.sqrt((qm ** 2).sum(1)).max() + np.sqrt((bm ** 2).sum(1)).max()) + 1e-12
    limit = q["t"].to_numpy(dtype=np.float64)
    if len(ids) > k:
        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + error)
    at, c = np.nonzero((rough <= (limit + error)[:, None]) & np.isfinite(rough))
    d = np.empty(len(at))
    for i in range(0, len(at), CELLS // 64):        # many, where vectors repeat
        part = slice(i, i + CELLS // 64)
        d[part] = np.sqrt(((qm[at[part]] - bm[c[part]]) ** 2).sum(1))
    order = np.lexsort((ids[c], d, at))
    at, c, d = at[order], c[order], d[order]
    starts = np.searchsorted(at, np.arange(len(q)))
    keep = np.arange(len(at)) - starts[at] < k
    at, c, d = at[keep], c[keep], d[keep]
    return pd.DataFrame({"qrow": q["row"].to_numpy()[at], "query_id": q["vec_id"].to_numpy()[at],
                         "vec_id": ids[c], "d": d})


FOUND = "qrow long, query_id long, vec_id long, d double"


def _streamed(k: int):
    """Rows come by block: its vectors first (probe 0), then the probes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, vectors, m = None, [], None
        for frame in frames:
            for block, part in frame.groupby("block", sort=False):
                if block != name:
                    name, vectors, m = block, [], None
                own = part[part["probe"] == 0]
                if len(own):
                    vectors.append(own)
                    m = None
                asked = part[part["probe"] == 1]
                if not len(asked):
                    continue
                if m is None:
                    vectors = [pd.concat(vectors)] if vectors else []
                    m = _matrix(vectors[0]["v"]) if vectors else None
                if vectors:
                    step = max(1, min(1024, CELLS // len(m)))
                    for a in range(0, len(asked), step):
                        yield _best(asked.iloc[a:a + step], vectors[0], m, k)
    return run


def _search(lists: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    cols = ["block", "row", "vec_id", "v"]
    both = lists.select(*cols, F.lit(0).alias("probe"), F.lit(0.0).alias("t")).unionByName(
        probes.select(*cols, F.lit(1).alias("probe"), "t"))
    return both.repartition("block").sortWithinPartitions("block", "probe").mapInPandas(_streamed(k), FOUND)


def _probes(frames: Iterator[pd.DataFrame], centres: np.ndarray, names: np.ndarray, of: np.ndarray, near: np.ndarray,
            far: np.ndarray) -> Iterator[pd.DataFrame]:
    """For each vector the other blocks within its reach.  It may ask every
    block, so rows and probes go on in parts whose size does not depend on
    the number of blocks."""
    step = max(1, min(1024, CELLS // len(names)))
    for whole in frames:
        for a in range(0, len(whole), step):
            frame = whole.iloc[a:a + step]
            to = _distances(_matrix(frame["v"]), centres)[:, of]
            t = frame["t"].to_numpy()[:, None]
            gap = SLACK * (to + far) + 1e-12
            can = (to <= far + t + gap) & (to >= near - t - gap) & (frame["block"].to_numpy()[:, None] != names)
            q, b = np.nonzero(can)
            for i in range(0, len(q), SENT):
                asks = frame.iloc[q[i:i + SENT]]
                yield pd.DataFrame({"block": names[b[i:i + SENT]], "row": asks["row"].to_numpy(),
                                    "vec_id": asks["vec_id"].to_numpy(), "v": asks["v"].to_numpy(),
                                    "t": asks["t"].to_numpy()})


def nearest_of_all(emb: DataFrame, k: int = 5, dims: int = 64, block_rows: int = 4096, max_centres: int = 1024,
                   max_blocks: int = 65_536, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For every vector its k nearest others: query_id, rank (from 1), vec_id,
    distance; ties go to the smaller vec_id.

    Vectors of exactly ``dims`` finite components take part.  Rows that share
    an id are not each other's neighbours; each of them is asked for, and each
    can be found.  Fewer than k others: all of them.
    """
    spark = emb.sparkSession
    fine = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = emb.filter(F.col(id_col).isNotNull() & (F.size(vec_col) == dims) & F.coalesce(fine, F.lit(False))) \
        .select(F.col(id_col).cast("long").alias("vec_id"),
                F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    stored = scratch_dir(spark, "neighbour-rows")
    # Written once, so that a row keeps its number whatever is recomputed.
    kept.withColumn("row", F.monotonically_increasing_id()).write.parquet(stored)
    kept = spark.read.parquet(stored)
    n = kept.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")
    block_rows = max(block_rows, -(-2 * n // max_blocks))
    n_centres = min(max_centres, max(1, n // block_rows * 2 + 1))
    drawn = kept.orderBy(F.xxhash64("vec_id"), "row").limit(4 * n_centres).collect()      # at most 4 x max_centres
    centres = _far_apart(_matrix(pd.Series([r.v for r in drawn])), n_centres)

    def assign(frames):
        for whole in frames:
            for a in range(0, len(whole), SENT):
                frame = whole.iloc[a:a + SENT]
                d = _distances(_matrix(frame["v"]), centres)
                at = d.argmin(1)
                yield frame.assign(list=at.astype("int32"), far=d[np.arange(len(at)), at])

    dealt = kept.mapInPandas(assign, "vec_id long, v array<double>, row long, list int, far double")
    first = scratch_dir(spark, "neighbour-dealt")
    dealt.write.parquet(first)
    dealt = spark.read.parquet(first)
    # Within a list vectors are cut into shells by their distance from the
    # centre, at quantiles, so that a list with a third of all rows is many
    # blocks; equal distances are dealt by row.
    sizes = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "far", F.array(*[F.lit(i / 32) for i in range(1, 32)]), 10_000).alias("cuts"))
    shell = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    parts = F.greatest(F.round(F.col("m") / F.lit(float(block_rows))).cast("long"), F.lit(1).cast("long"))
    layered = dealt.join(sizes, "list").withColumn("layer", F.when(F.col("n") > block_rows, shell).otherwise(F.lit(0)))
    fill = layered.groupBy("list", "layer").agg(F.count(F.lit(1)).alias("m"))
    block = F.concat_ws("-", "list", "layer", F.pmod(F.xxhash64("row"), parts))
    placed = scratch_dir(spark, "neighbour-lists")
    layered.join(fill, ["list", "layer"]).select("list", block.alias("block"), "row", "vec_id", "v", "far") \
        .repartition("list", "block").write.partitionBy("list").parquet(placed)
    lists = spark.read.parquet(placed)

    # Round 1: everything in its own block.
    own = scratch_dir(spark, "neighbour-own")
    _search(lists, lists.withColumn("t", F.lit(float("inf"))), k).write.parquet(own)
    own = spark.read.parquet(own)
    bound = own.groupBy(F.col("qrow").alias("row")).agg(F.count(F.lit(1)).alias("m"), F.max("d").alias("t"))

    # Round 2: every other block that the bounds cannot rule out.
    about = lists.groupBy("block", "list").agg(F.min("far").alias("near"), F.max("far").alias("far")).collect()
    names = np.array([r.block for r in about])
    of = np.array([r.list for r in about])
    near, far = (np.array([r[c] for r in about]) for c in ("near", "far"))

    def probe(frames):
        return _probes(frames, centres, names, of, near, far)

    asked = lists.join(bound, "row", "left").select(
        "block", "row", "vec_id", "v",
        F.when(F.col("m") >= k, F.col("t")).otherwise(F.lit(float("inf"))).alias("t"))
    probes = asked.mapInPandas(probe, "block string, row long, vec_id long, v array<double>, t double")
    found = own.unionByName(_search(lists, probes, k))
    order = Window.partitionBy("qrow").orderBy("d", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", rnd(F.col("d"), 4).alias("distance"))
