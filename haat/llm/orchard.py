"""Centroid clustering whose assignments are found by Orchard's search.

Components become floor(64 x) as integers, so all distances, means and ties
are exact.  Every centroid has the list of the others by their distance from
it.  A vector starts at the centroid whose length is nearest to its own and
walks that centroid's list; as soon as it meets a closer centroid it goes on
with that one's list, passing over centroids it has met before.  It stops
where the list is strictly beyond twice its distance from the current centroid:
by the triangle inequality everything from there on is strictly farther.

A round is one pass over the vectors.  A task brings back k rows, the
count and the componentwise sums of each cluster, which Spark adds up; only
k x dims sums reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.llm.common import cut, ship, task
from haat.llm.topk import quantised, usable

LARGEST = 1 << 26        # component; squared distances of 64 such stay under 2 ** 62
CELLS = 1 << 22          # marks (vector, centroid) kept at once


class Orchard:
    """Nearest centroids: ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.c = c = centroids.astype(np.int64)
        k = len(c)
        gaps = np.stack([((c - x) ** 2).sum(1) for x in c])
        self.lists = np.stack([np.lexsort((np.arange(k), g)) for g in gaps])
        self.gaps = np.take_along_axis(gaps, self.lists, 1)
        lengths = np.sqrt((c.astype(np.float64) ** 2).sum(1))
        self.by_length = np.argsort(lengths, kind="stable")
        self.between = (lengths[self.by_length][1:] + lengths[self.by_length][:-1]) / 2

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance, distances computed) for each row."""
        step = max(1, CELLS // len(self.c))
        parts = [self._nearest(x[a:a + step]) for a in range(0, len(x), step)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _nearest(self, x):
        n, k = len(x), len(self.c)
        at = self.by_length[np.searchsorted(self.between, np.sqrt((x.astype(np.float64) ** 2).sum(1)))]
        best = ((x - self.c[at]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), at] = True
        place, met = np.zeros(n, np.int64), np.ones(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            p = place[rows]
            on = p < k
            rows, p = rows[on], p[on]
            on = self.gaps[at[rows], p] <= 4 * best[rows]
            rows, p = rows[on], p[on]
            other = self.lists[at[rows], p]
            place[rows] += 1
            fresh = ~seen[rows, other]
            r, o = rows[fresh], other[fresh]
            seen[r, o] = True
            met[r] += 1
            d = ((x[r] - self.c[o]) ** 2).sum(1)
            closer = (d < best[r]) | ((d == best[r]) & (o < at[r]))
            r, o = r[closer], o[closer]
            at[r], best[r], place[r] = o, d[closer], 0
        return at, best, met


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: str = "1",
             id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), n_compared
    (distances computed in its last search), cluster_inertia, inertia,
    centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null, NaN or
    infinite.  Centroids start as the k kept vectors with the smallest
    sha256 of "seed:id".  In each of ``rounds`` rounds every vector goes to its
    nearest centroid and non-empty centroids become the floored means; then
    all are assigned once more.

    * a null vec_id takes part; it starts a centroid only where fewer than k
      vectors have ids;
    * rows that repeat an id count each; among equal hashes the smaller vector
      comes first; equal centroids: the smaller number has all their vectors;
    * fewer than k vectors: as many centroids; none: an empty result;
    * components beyond +-2^20 raise a ValueError: their squared distances
      would not fit the result;
    * other columns are not read.  The lists take k^2 entries in each worker.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "vec_id long, cluster int, distance long, n_compared int"
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")) \
        .filter(usable(F.col("v")) & (F.size("v") == dims)).select("id", quantised(F.col("v")).alias("v"))
    far = F.exists("v", lambda x: (x > LARGEST) | (x < -LARGEST))
    kept = cut(kept.select("id", F.when(~far, F.col("v").cast("array<int>")).alias("v")))
    if kept.filter("v is null").limit(1).count():
        raise ValueError(f"a component lies beyond +-{LARGEST // 64}")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v") \
        .limit(k).collect()
    if not first:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        centroids = _means(kept, centroids)
    found = cut(kept.mapInArrow(task(_assign(Orchard(centroids))), schema))
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One row per centroid, k in all.
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(i, per.get(i, 0), sum(per.values()), s) for i, s in enumerate(shas)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "n_compared", "cluster_inertia", "inertia", "centroid_sha256")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def _assign(search: Orchard):
    def run(batches):
        for batch in batches:
            if len(batch):
                at, d, met = search.nearest(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(at.astype(np.int32)), pa.array(d), pa.array(met.astype(np.int32))],
                    ["vec_id", "cluster", "distance", "n_compared"])
    return run


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    search, k = Orchard(centroids), len(centroids)

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1))
                at, _, _ = search.nearest(x)
                order = np.argsort(at, kind="stable")
                has, starts = np.unique(at[order], return_index=True)
                sums[has] += np.add.reduceat(x[order], starts)
                n += np.bincount(at, minlength=k)
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(n[has]),
                                          pa.array(sums[has].tolist(), pa.list_(pa.int64()))], ["c", "n", "sums"])

    parts = vectors.mapInArrow(task(run), "c int, n long, sums array<long>")
    totals = parts.select("c", "n", F.posexplode("sums").alias("j", "x")).groupBy("c", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(28,0)")).alias("x")).collect()     # k x dims rows
    out = centroids.copy()
    for r in totals:
        out[r.c, r.j] = int(r.x) // r.n
    return out
