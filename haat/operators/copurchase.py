"""Products bought by the same customers (J7, M9): the projection of the
product-customer graph onto its products.

Two products are linked by the customers who bought both.  A customer with d
products makes d (d - 1) / 2 pairs, so one customer with very many would keep
one task busy.  A customer's products are therefore dealt into
ceil(d / block) blocks by hash, and each pair of blocks (i <= j) is a join key
of its own: a triangle of keys, none with more than about block x block
pairs, which Spark spreads over all tasks.  Counts combine map-side.

Where only the nearest are wanted, pairs are not shuffled at all: see
``copurchase_neighbours``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haat.session import scratch_dir

AT_ONCE = 1 << 20       # pairs that a task counts at once, at least
ROWS = 2048             # blocks whose pairs are made at once
# Tasks get this module's functions whole: their workers need no package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def purchases(tx: DataFrame, item: str = "product", user: str = "user_id") -> DataFrame:
    """The graph's edges, each once: (item, user)."""
    return tx.select(F.col(item).alias("item"), F.col(user).alias("user")).dropna().distinct()


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def _clearing(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go when it has run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _dropped(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _held(edges: DataFrame, block: int, value: str = "item") -> DataFrame:
    """Each customer's products in blocks of about ``block``: user, n (blocks of
    the customer), i (from 0) and x, the block's ``value`` as a sorted array."""
    # Read from files, so that adaptive execution can split a customer's rows
    # in the join with the few large degrees.
    large = _written(edges.groupBy("user").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > block), "degrees")
    blocks = F.coalesce(F.ceil(F.col("d") / block), F.lit(1)).cast("int")
    dealt = edges.join(large, "user", "left").select(
        "user", F.col(value).alias("value"), blocks.alias("n"), F.pmod(F.xxhash64("item"), blocks).cast("int").alias("mine"))
    return dealt.groupBy("user", "n", F.col("mine").alias("i")).agg(F.sort_array(F.collect_list("value")).alias("x"))


def pair_counts(edges: DataFrame, block: int = 256) -> DataFrame:
    """(a, b, both) for products a < b with at least one common customer."""
    held = _held(_written(edges, "purchases"), block)
    inside = held.filter(F.size("x") > 1).select(F.explode(F.flatten(F.transform("x", lambda a, at: F.transform(
        F.slice("x", at + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    # Block i of a customer with several meets each later block j.
    several = held.filter(F.col("n") > 1)
    left = several.filter(F.col("i") < F.col("n") - 1).select(
        "user", "i", "x", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j"))
    right = several.filter(F.col("i") > 0).select(
        "user", F.col("i").alias("j"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("i"))
    across = left.join(right, ["user", "i", "j"]).select(F.explode(F.flatten(F.transform("x", lambda a: F.transform(
        "y", lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))).alias("p"))
    pairs = inside.unionByName(across).select("p.a", "p.b")
    return pairs.groupBy("a", "b") \
        .agg(F.count(F.lit(1)).alias("both"))


def copurchase(edges: DataFrame, block: int = 256) -> DataFrame:
    """Both directions of every pair: item, other, both (common customers),
    cosine = both / sqrt(customers of item x customers of other)."""
    counts = _written(pair_counts(edges, block), "pairs")
    sizes = edges.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    ways = counts.select(F.col("a").alias("item"), F.col("b").alias("other"), "both").unionByName(
        counts.select(F.col("b").alias("item"), F.col("a").alias("other"), "both"))
    return ways.join(sizes, "item").join(sizes.toDF("other", "other_size"), "other").select(
        "item", "other", "both",
        (F.col("both") / F.sqrt(F.col("size").cast("double") * F.col("other_size").cast("double"))).alias("cosine"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """(item, size) with ``id``: dense integers from 0, in the items' order."""
    placed = _written(sizes.orderBy("item").withColumn("place", F.monotonically_increasing_id()), "sizes")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition of the sort.
    starts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, part == F.col("part")).select("item", "size", (F.col("start") + within).alias("id"))


NEAREST = "id long, rank int, other long, both long, cosine double"


def _nearest(counts: DataFrame, k: int) -> DataFrame:
    """The k best of (id, size, other, other_size, both) for each id."""
    cosine = F.col("both") / F.sqrt(F.col("size").cast("double") * F.col("other_size").cast("double"))
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("both").desc(), F.col("other"))
    return counts.withColumn("cosine", cosine).withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= k).select("id", "rank", "other", "both", "cosine")


def _pairs(batch: pa.RecordBatch) -> list[np.ndarray]:
    """id, size, other, other_size and 1 for every pair of a batch."""
    rows = [batch.column(c).to_numpy() for c in ("id", "size")]
    many = np.diff(batch.column("o").offsets.to_numpy())
    pairs = [np.repeat(r, many) for r in rows] + [batch.column(c).flatten().to_numpy() for c in ("o", "s")]
    kept = pairs[0] != pairs[2]
    return [p[kept] for p in pairs] + [np.ones(kept.sum(), np.int64)]


def _sums(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The pairs of ``parts``, which come by id, each once and by (id, other)."""
    pairs = [np.concatenate(p) for p in zip(*parts)]
    if not len(pairs[0]):
        return pairs
    product = np.cumsum(np.diff(pairs[0], prepend=pairs[0][0]) != 0)
    key = product * (pairs[2].max() + 1) + pairs[2]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return [p[order[first]] for p in pairs[:4]] + [np.add.reduceat(pairs[4][order], first)]


def _best(found: list[np.ndarray], k: int) -> pa.RecordBatch:
    """The k best of each id, which come by (id, other)."""
    ids, size, other, other_size, both = found
    cosine = both / np.sqrt(size.astype(np.float64) * other_size.astype(np.float64))
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    if len(first):
        # Only what reaches an id's k-th greatest cosine is sorted: each turn
        # takes its greatest, with all that equal it.
        many = np.diff(first, append=len(ids))
        rest, taken, least = cosine.copy(), np.zeros(len(first), np.int64), np.zeros(len(first))
        for _ in range(k):
            top = np.maximum.reduceat(rest, first)
            least = np.where(taken < k, top, least)
            equal = rest == np.repeat(top, many)
            taken += np.add.reduceat(equal, first, dtype=np.int64)
            rest[equal] = -1
        reach = cosine >= np.repeat(least, many)
        ids, other, both, cosine = (c[reach] for c in (ids, other, both, cosine))
    order = np.lexsort((other, -both, -cosine, ids))
    at = np.arange(len(ids))
    rank = at - np.maximum.accumulate(np.where(np.diff(ids, prepend=-1) != 0, at, 0)) + 1
    order, rank = order[rank <= k], rank[rank <= k]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (ids[order], rank.astype(np.int32), other[order], both[order], cosine[order])],
        ["id", "rank", "other", "both", "cosine"])


def _counted(k: int):
    """``_nearest`` for rows that come by id (id, size, o, s; ``o`` and ``s``
    are a block's numbers and sizes).  A task holds the pairs of one product
    and of about ``AT_ONCE`` more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, enough = [], 0, AT_ONCE
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            parts.append(_pairs(batch))
            n += len(parts[-1][0])
            if n >= enough:
                found = _sums(parts)
                # The last product may go on in the next batch.
                last = int(np.searchsorted(found[0], found[0][-1]))
                yield _best([f[:last] for f in found], k)
                parts = [[f[last:] for f in found]]
                n = len(parts[0][0])
                enough = max(AT_ONCE, 2 * n)
        if parts:
            yield _best(_sums(parts), k)
    return run


def _in_rounds(edges: DataFrame, k: int, block: int, hot: int, pairs_per_task: int, pairs_per_round: int,
               pairs_per_edge: int) -> tuple[DataFrame, str]:
    """The numbered products, and the folder of each one's k best."""
    spark = edges.sparkSession
    bought, of_number, in_blocks, nearest = (scratch_dir(spark, n) for n in ("purchases", "numbered", "held", "nearest"))
    edges.write.parquet(bought)
    edges = spark.read.parquet(bought)
    items = _written(_numbered(edges.groupBy("item").agg(F.count(F.lit(1)).alias("size"))), "items")
    edges.join(items, "item").select("user", F.col("id").alias("item"), "size").write.parquet(of_number)
    _dropped(spark, bought)
    held = _held(spark.read.parquet(of_number).withColumn("entry", F.struct("item", "size")), block, "entry")
    # Sizes up to 127 take one byte, numbers up to 2^31 four; longer ones are kept whole.
    sizes, ids = F.col("x.size"), F.col("x.item")
    held.select(
        "user", "n", "i", F.size("x").alias("m"),
        F.when(F.array_max(sizes) < 128, sizes.cast("array<tinyint>")).alias("size1"),
        F.when(F.array_max(sizes) >= 128, sizes).alias("size8"),
        F.when(F.array_max(ids) < 1 << 31, ids.cast("array<int>")).alias("id4"),
        F.when(F.array_max(ids) >= 1 << 31, ids).alias("id8")).write.parquet(in_blocks)
    _dropped(spark, of_number)
    held = spark.read.parquet(in_blocks)
    packed = ["size1", "size8", "id4", "id8"]
    numbers = F.coalesce(F.col("id4").cast("array<bigint>"), "id8").alias("o")
    of_size = F.coalesce(F.col("size1").cast("array<bigint>"), "size8").alias("s")
    entries = F.explode(F.arrays_zip(numbers, of_size))
    n_edges, n_pairs = held.groupBy("user").agg(F.sum("m").cast("double").alias("d")) \
        .agg(F.coalesce(F.sum("d"), F.lit(0.0)), F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0))).first()
    rounds = max(math.ceil(n_pairs / max(pairs_per_round, pairs_per_edge * n_edges)), 1)
    tasks = min(max(math.ceil(n_pairs / rounds / pairs_per_task), int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    some_hot = items.filter(F.col("size") > hot).limit(1).count() > 0

    for turn in range(rounds):
        mine = F.pmod(F.xxhash64("me.o"), F.lit(rounds)) == turn
        one = held.filter((F.col("n") == 1) & (F.col("m") > 1)).select(entries.alias("me"), *packed).filter(mine)
        # A product of a customer with several blocks meets every block, its own too.
        several = held.filter(F.col("n") > 1)
        left = several.select("user", "n", entries.alias("me")).filter(mine) \
            .select("user", "me", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        across = left.join(several.select("user", "i", *packed), ["user", "i"]).select("me", *packed)
        sent = one.unionByName(across).select(F.col("me.o").alias("id"), F.col("me.s").alias("size"), *packed)
        cold = sent.filter(F.col("size") <= hot).repartition(tasks, "id")
        cold.select("id", "size", numbers, of_size).sortWithinPartitions("id").mapInArrow(_counted(k), NEAREST) \
            .write.mode("append").parquet(nearest)
        if some_hot:
            pairs = sent.filter(F.col("size") > hot).select("id", "size", entries.alias("p")) \
                .select("id", "size", F.col("p.o").alias("other"), F.col("p.s").alias("other_size")) \
                .filter(F.col("id") != F.col("other")) \
                .groupBy("id", "size", "other", "other_size").agg(F.count(F.lit(1)).alias("both"))
            _nearest(pairs, k).write.mode("append").parquet(nearest)
    _dropped(spark, in_blocks)
    return items, nearest


def copurchase_neighbours(edges: DataFrame, k: int = 5, block: int = 256, hot: int = 50_000,
                          pairs_per_task: int = 2_000_000, pairs_per_round: int = 32_000_000,
                          pairs_per_edge: int = 4) -> DataFrame:
    """Each product's k nearest by cosine (ties: more common customers, then
    the smaller product).

    Pairs are never shuffled.  A product is sent the blocks of its customers'
    products, as arrays of dense numbers with the products' sizes beside them
    (about 4 bytes a pair); the task that has all of a product's blocks counts
    its pairs and keeps k.  Products with more than ``hot`` customers are
    counted map-side first, so that none of them keeps one task busy.

    A customer with d products makes d x d pairs, many times the purchases
    themselves, so products are taken in rounds of ``pairs_per_edge`` pairs a
    purchase (``pairs_per_round`` at least).  A round's arrays are removed
    before the next one, and each written step once the next is written: disk
    grows with the purchases and not with the pairs.
    """
    spark = edges.sparkSession
    with _clearing(spark):
        items, nearest = _in_rounds(edges, k, block, hot, pairs_per_task, pairs_per_round, pairs_per_edge)
    best, names = spark.read.parquet(nearest), items.select("id", "item")
    return best.join(names, "id").join(names.toDF("other", "name"), "other").select(
        "item", "rank", F.col("name").alias("other"), "both", "cosine")
