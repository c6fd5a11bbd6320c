"""Sharding by longest-processing-time scheduling.

Rows with equal text stay together.  Groups, by size, go to the least-loaded
shard through a heap.  The heap works on a bounded number of units: a group of
at least 1/(shards x units) of all bytes is a unit of its own (there are at
most shards x units of them), and the smaller groups are dealt by hash into
shards x units buckets, each a unit.  So at most 2 x shards x units rows,
whatever the input, reach the driver; everything else is aggregation and
joins against those bounded tables.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.llm.common import cut, ranked


def longest_first(sizes: list[tuple], n_shards: int) -> dict:
    """key -> shard for (key, size): by falling size (ties: smaller key), each
    to the shard with the least load (ties: smaller shard)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[key] = shard
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16,
          units_per_shard: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes + 1), text_crc32,
    shard, slot (0-based place in the shard by doc_id, nulls first).

    Null text counts as empty (size 1) and groups with it.  Groups are found by
    a 64-bit hash of the text: a collision would put two groups into one shard
    together, which no rule forbids.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("grp")))
    total = slim.agg(F.sum("size")).first()[0] or 0
    n_units = n_shards * units_per_shard
    groups = slim.groupBy("grp").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * n_units >= F.lit(total)
    units = groups.groupBy(large.alias("large"),
                           F.when(large, F.col("grp")).otherwise(F.pmod("grp", F.lit(n_units))).alias("unit")) \
        .agg(F.sum("bytes").alias("bytes"))
    # At most 2 x n_units rows, by the argument above.
    placed = longest_first([((r.large, r.unit), r.bytes) for r in units.collect()], n_shards)
    at = spark.createDataFrame([(k[0], k[1], s) for k, s in placed.items()],
                               "large boolean, unit long, shard int")
    own = at.filter("large").select(F.col("unit").alias("grp"), F.col("shard").alias("own"))
    dealt = at.filter("not large").select(F.col("unit").alias("bucket"), F.col("shard").alias("dealt"))
    out = slim.withColumn("bucket", F.pmod("grp", F.lit(n_units))) \
        .join(F.broadcast(own), "grp", "left").join(F.broadcast(dealt), "bucket", "left") \
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "dealt").alias("shard"))
    return ranked(out, "shard", "doc_id", "slot", tie=F.col("text_crc32")) \
        .select("doc_id", "size", "text_crc32", "shard", "slot")
