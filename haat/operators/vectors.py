"""Vector lookups over ``embeddings``.

The reference only adds vectors to a flat L2 index.  The lookup it enables
is exact k-nearest-neighbour search; here the query set is the centroid of
each label, scored against every stored vector.

Plan: vectors are dealt into blocks by id hash and the query table is
repeated once per block, so each block of vectors meets each query through an
equality join, whatever the number of queries.  A query table whose measured
size is within a bound is broadcast, and the vectors stay where they are;
beyond it blocks are as many as the vectors ask for, and the two are shuffled
together.  The ``rank <= k`` filter over the per-query window becomes a group
limit before the shuffle, so only k rows per query and task are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd

BROADCAST_BYTES = 4 << 20       # of query components that are broadcast at most (twice, once per block)
ROWS_PER_BLOCK = 50_000


def centroids(emb: DataFrame) -> DataFrame:
    """Per label: element-wise mean vector (aggregated per (label, position)
    first, so each label's collect holds only ``dim`` values)."""
    pe = emb.select("label", F.posexplode("embedding").alias("pos", "x"))
    comp = pe.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return comp.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
        .alias("vec"))


def l2(a, b):
    """Euclidean distance of two equal-length arrays, in double."""
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) *
                    (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def knn_l2(emb: DataFrame, queries: DataFrame, k: int = 5, blocks: int | None = None,
           broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top-k by L2 for each query ``(qid, vec)`` over all of ``emb``.

    The queries' components are counted first.  Where they fit
    ``broadcast_bytes`` no vector is shuffled; otherwise there is a block per
    ``ROWS_PER_BLOCK`` vectors, unless ``blocks`` says how many.
    """
    components = queries.agg(F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0))).first()[0]
    small = 8 * components <= broadcast_bytes
    if blocks is None:
        blocks = 2 if small else max(2, math.ceil(emb.count() / ROWS_PER_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    per_block = queries.select("qid", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    dealt = emb.select("vec_id", "embedding", block.alias("b"))
    scored = dealt.join(F.broadcast(per_block) if small else per_block, "b").select(
        "vec_id", "qid", l2(F.col("vec"), F.col("embedding")).alias("d"))
    w = Window.partitionBy("qid").orderBy(F.col("d").asc(), F.col("vec_id").asc())
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "rank", "vec_id", rnd(F.col("d"), 4).alias("distance")))


def knn_label_centroids(emb: DataFrame, k: int = 5) -> DataFrame:
    """Registered form: each label's centroid as a query."""
    q = centroids(emb).select(F.col("label").alias("qid"), "vec")
    return knn_l2(emb, q, k).withColumnRenamed("qid", "label")
