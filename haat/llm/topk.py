"""Exact top-k by inner product with a pivot table.

Components become floor(64 x) as integers, so scores are exact.  Every vector
keeps its distances to many pivots.  By the triangle inequality
d(q, x) >= |d(q, p) - d(x, p)| for each pivot p, and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so the largest such difference bounds
the score from above.  The same holds for a group of vectors with the least
and the greatest distance to each pivot.

Vectors with the same nearest pivot make blocks of bounded size, and within a
block leaves of ``LEAF`` vectors, by their distance from that pivot.

* Round 1: a query is searched in its own block, near itself; its k-th score
  there is the least that counts from now on.
* Round 2: it goes to the blocks whose bound reaches that score, and no others.

In a block the leaves come in the order of their bounds.  A leaf whose bound
lies under a query's k-th score is passed over for it, all later ones too; the
others are evaluated for all queries at once, as a matrix product.  Bounds get
slack for rounding, and those equal to the k-th score are evaluated, so ties go
to the smaller id exactly.

A block's vectors are read by one task and the queries stream past them: no
vector is copied per query, and memory is one block and one batch of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haat.llm.common import cut, ship, task

LEAF = 512                # candidates evaluated at once
QUERIES = 512             # queries that meet a block at once
LARGEST = 1 << 26         # component; scores of some hundred dimensions fit 64 bits


def quantised(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 64).cast("long"))


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` vectors, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [int((sample ** 2).sum(1).argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def to_pivots(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots, good to about 1e-7 of the lengths."""
    m = m.astype(np.float64)
    return np.sqrt(np.maximum((m ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * m @ pivots.T, 0))


def bounds(q2: np.ndarray, q_piv: np.ndarray, c2: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of each query in each group: groups have
    squared lengths up to c2, and pivot distances from low to high."""
    gap = np.zeros((len(q2), len(c2)))
    for p in range(q_piv.shape[1]):
        d = q_piv[:, p, None]
        np.maximum(gap, np.maximum(low[:, p] - d, d - high[:, p]), out=gap)
    scale = np.sqrt(q2)[:, None] + np.sqrt(c2)
    gap = np.maximum(gap - 1e-6 * scale - 1e-6, 0)
    return np.minimum((q2[:, None] + c2 - gap * gap) / 2, np.sqrt(q2)[:, None] * np.sqrt(c2)) * (1 + 1e-9) + 1


class Block:
    """Candidates, in leaves by their distance from the nearest pivot."""

    def __init__(self, rows, ids, m: np.ndarray, piv: np.ndarray):
        order = np.lexsort((piv.min(1), piv.argmin(1)))
        self.rows, self.ids, self.m, piv = rows[order], ids[order], m[order], piv[order]
        at = np.arange(0, len(m), LEAF)
        self.at = np.append(at, len(m))
        norms = (self.m.astype(np.float64) ** 2).sum(1)
        self.c2 = np.maximum.reduceat(norms, at)
        self.low, self.high = np.minimum.reduceat(piv, at), np.maximum.reduceat(piv, at)
        self.evaluated = 0

    def search(self, rows, q: np.ndarray, q_piv, least, k: int):
        """(query's place, candidate id, score) of each query's k best that
        reach ``least`` (-inf: no such limit)."""
        q2 = (q.astype(np.float64) ** 2).sum(1)
        limit = bounds(q2, q_piv, self.c2, self.low, self.high)
        small = max(q2.max(initial=0), 1) * max(self.c2.max(initial=0), 1) < 2 ** 104     # products under 2^53
        qf, cf = (q.astype(np.float64), self.m.astype(np.float64)) if small else (q, self.m)
        best = np.full((len(q), k), -np.inf)
        least = least.astype(np.float64).copy()
        hits = []
        for leaf in np.argsort(-limit.max(0), kind="stable"):
            who = np.flatnonzero(limit[:, leaf] >= least)
            if not len(who):
                continue
            a, z = self.at[leaf], self.at[leaf + 1]
            exact = qf[who] @ cf[a:z].T
            self.evaluated += exact.size
            s = exact.astype(np.float64)
            s[rows[who][:, None] == self.rows[a:z]] = -np.inf
            best[who] = np.partition(np.concatenate([best[who], s], 1), -k, axis=1)[:, -k:]
            least[who] = np.maximum(least[who], best[who].min(1))
            i, j = np.nonzero((s >= least[who][:, None]) & np.isfinite(s))
            hits.append((who[i], a + j, exact[i, j].astype(np.int64)))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        at, c, s = (np.concatenate(x) for x in zip(*hits))
        keep = s.astype(np.float64) >= least[at]
        at, c, s = at[keep], c[keep], s[keep]
        order = np.lexsort((self.ids[c], -s, at))
        at, c, s = at[order], c[order], s[order]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[keep], self.ids[c[keep]], s[keep]


def _matrix(vecs, dims: int) -> np.ndarray:
    m = np.zeros((len(vecs), dims), np.int64)
    for i, x in enumerate(vecs):
        m[i, :len(x)] = x
    return m


FOUND = "qrow long, query_id long, vec_id long, score long"


def _streamed(dims: int, k: int):
    """Rows come by block: its vectors first, then the queries (``least`` not null)."""
    def answer(block, asked):
        for a in range(0, len(asked), QUERIES):
            some = asked.iloc[a:a + QUERIES]
            rows, ids = some["row"].to_numpy(), some["id"].to_numpy()
            at, found, s = block.search(rows, _matrix(some["v"], dims), np.stack(some["piv"].to_list()).astype(np.float64),
                                        some["least"].to_numpy(), k)
            yield pd.DataFrame({"qrow": rows[at], "query_id": ids[at], "vec_id": found, "score": s})

    def run(frames):
        name, parts, block = None, [], None
        for frame in frames:
            for b, part in frame.groupby("block", sort=False):
                if b != name:
                    name, parts, block = b, [], None
                asks = part["asks"].to_numpy()
                if not asks.all():
                    parts.append(part[~asks])
                if asks.any():
                    if block is None and parts:
                        all_of = pd.concat(parts)
                        block = Block(all_of["row"].to_numpy(), all_of["id"].to_numpy(), _matrix(all_of["v"], dims),
                                      np.stack(all_of["piv"].to_list()).astype(np.float64))
                        parts = []
                    if block is not None:
                        yield from answer(block, part[asks])
    return run


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          query_every: int = 20, n_pivots: int = 64, sample_rows: int = 4096, block_rows: int = 8192,
          max_blocks: int = 16_384) -> DataFrame:
    """Each query's k highest scores: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    are all rows but the query's own.  Pivots are chosen farthest-first from
    ``sample_rows`` rows (the first by id hash); they decide speed, never
    results.  The blocks' bounds, sent to every task, are at most about
    ``max_blocks`` rows; blocks grow beyond that.

    * rows with a null id, a null vector, or a null, NaN or infinite component
      take no part; an empty vector counts as zero;
    * shorter vectors are padded with zeros;
    * rows that repeat an id are candidates each, of each other too, and
      queries each, with ranks of their own;
    * fewer than k candidates: all of them; ties: smaller id first;
    * components beyond +-2^20 raise a ValueError: scores would not fit;
    * an empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    far = F.exists("v", lambda x: (x > LARGEST) | (x < -LARGEST))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")) \
        .filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantised(F.col("v")).alias("v"))
    v = cut(v.select(F.monotonically_increasing_id().alias("row"), "id",
                     F.when(~far, F.col("v").cast("array<int>")).alias("v")))
    n, fit, dims = v.agg(F.count(F.lit(1)), F.count("v"), F.max(F.size("v"))).first()
    if n != fit:
        raise ValueError(f"a component lies beyond +-{LARGEST // 64}")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, 1)
    sample = v.orderBy(F.xxhash64("id"), "row").limit(sample_rows).collect()
    pivots = choose_pivots(_matrix([r.v for r in sample], dims).astype(np.float64), n_pivots)

    def with_pivots(frames):
        for frame in frames:
            far = to_pivots(_matrix(frame["v"], dims), pivots)
            yield frame.assign(piv=list(far.astype(np.float32)), cell=far.argmin(1).astype("int32"))

    table = cut(v.mapInPandas(task(with_pivots), "row long, id long, v array<int>, piv array<float>, cell int"))
    # At most n_pivots rows; a cell with many vectors is dealt into several blocks.
    block_rows = max(block_rows, -(-n // max_blocks))
    parts = F.lit(1)
    for r in table.groupBy("cell").count().filter(F.col("count") > block_rows).collect():
        parts = F.when(F.col("cell") == r["cell"], F.lit(-(-r["count"] // block_rows))).otherwise(parts)
    # Small cells next to each other by number share a block, so that blocks are few.
    share = max(1, len(pivots) * block_rows // n)
    block = F.when(parts > 1, F.concat_ws("-", "cell", F.pmod(F.xxhash64("row"), parts))) \
        .otherwise(F.concat(F.lit("s"), F.floor(F.col("cell") / share).cast("string")))
    table = table.withColumn("block", block)

    def extent(frames):
        for frame in frames:
            for name, part in frame.groupby("block"):
                piv = np.stack(part["piv"].to_list())
                c2 = (_matrix(part["v"], dims).astype(np.float64) ** 2).sum(1).max()
                yield pd.DataFrame({"block": [name], "c2": [c2], "low": [piv.min(0)], "high": [piv.max(0)]})

    placed = cut(table.repartition("block").sortWithinPartitions("block"))
    about: dict = {}
    for r in placed.mapInPandas(task(extent), "block string, c2 double, low array<float>, high array<float>").collect():
        c2, low, high = about.get(r.block, (0.0, np.inf, -np.inf))
        about[r.block] = (max(c2, r.c2), np.minimum(low, r.low), np.maximum(high, r.high))
    names = np.array(list(about))
    c2, low, high = (np.array([x[i] for x in about.values()], np.float64) for i in range(3))

    def meet(asked: DataFrame) -> DataFrame:
        cols = ["block", "row", "id", "v", "piv"]
        both = placed.select(*cols, F.lit(False).alias("asks"), F.lit(0.0).alias("least")) \
            .unionByName(asked.select(*cols, F.lit(True).alias("asks"), "least"))
        return both.repartition("block").sortWithinPartitions("block", "asks").mapInPandas(
            task(_streamed(dims, k)), FOUND)

    queries = placed.filter(F.col("id") % query_every == 0)
    own = cut(meet(queries.withColumn("least", F.lit(float("-inf")))))
    reached = own.groupBy(F.col("qrow").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    queries = queries.join(reached, "row", "left").withColumn(
        "least", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))))

    def probes(frames):
        for frame in frames:
            q = _matrix(frame["v"], dims).astype(np.float64)
            limit = bounds((q ** 2).sum(1), np.stack(frame["piv"].to_list()).astype(np.float64), c2, low, high)
            i, j = np.nonzero((limit >= frame["least"].to_numpy()[:, None])
                              & (frame["block"].to_numpy()[:, None] != names))
            yield frame.iloc[i].assign(block=names[j])

    shape = "block string, row long, id long, v array<int>, piv array<float>, least double"
    others = meet(queries.select("block", "row", "id", "v", "piv", "least").mapInPandas(task(probes), shape))
    order = Window.partitionBy("qrow").orderBy(F.col("score").desc(), F.col("vec_id"))
    return own.unionByName(others).withColumn("rank", F.row_number().over(order).cast("int")) \
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
