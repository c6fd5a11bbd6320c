"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked at up to ``max_bits`` differing bits.  The
bits are cut into m groups, correlated bits together.  If thresholds t_i >= -1
add up to max_bits - m + 1, any two linked fingerprints differ by at most t_i
bits in some group i; so each fingerprint chooses its own thresholds, by
dynamic programming over the estimated number of candidates and the number of
probes, probes all values within t_i of its own in each group with t_i >= 0,
and verifies what it meets there on all 64 bits.

* Equal fingerprints are one node, found by a map-side combining aggregate.
* Bit correlations and histograms are sums over all fingerprints; they have a
  fixed size (64 x 64, and 2 x m tables of 2,048 counts), so they may go
  through the driver.
* Fingerprints and probes with the same value in the same group meet in one
  cell.  Cells with more than ``CELL`` fingerprints are split into a grid of
  cells of bounded size.  A cell gives the edges of a spanning forest, not all
  pairs: after its first probes, what they have joined counts as one node.
* Components come from large-star / small-star rounds, each written to the
  shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.llm.common import cut, ship, task

CELL = 8192            # fingerprints that a cell holds; eight times as many probes
PAIRS = 500_000      # pairs that are compared at once
SIZES = (22, 21, 21)   # bits of each group
BLOCK_BITS = 11        # bits of the blocks that the histograms count
DEEPEST = 2            # largest threshold of one group


# --- fingerprints ------------------------------------------------------------------

def fingerprint(text: str | None, size: int = 3) -> int:
    """A text's fingerprint, unsigned (see ``fingerprints``)."""
    from xxhash import xxh64_intdigest as digest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    a, b = starts[:len(words) - k + 1], ends[k - 1:]
    n, ones = len(a), np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        h = np.fromiter((digest(flat[i:j], 42) for i, j in zip(a[at:at + 65_536].tolist(),
                                                               b[at:at + 65_536].tolist())), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long).  A-Z are lower-cased,
    words end at ASCII white space, and shingles of ``size`` words count as
    often as they occur (fewer words: the whole sequence; none: fp 0).  A bit
    is 1 if it is set in over half of the shingles' XXH64 values (seed 42)."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(task(run), "doc_id long, fp long")


# --- bit groups and thresholds -----------------------------------------------------

def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(n, how often bits i and j are both set), over all fingerprints."""
    def run(batches):
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy()).astype(np.float32)
            both += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), n))], ["i", "n"])

    rows = fps.select("fp").mapInArrow(task(run), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097, np.int64)
    for r in rows:
        flat[r.i] = r.n
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(n: int, both: np.ndarray, sizes: tuple = SIZES) -> list[list[int]]:
    """Greedy groups: each begins with the free bit that is most correlated
    with the free ones, and takes the bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(64)), []
    for size in sizes:
        group = [max(free, key=lambda i: (corr[i, free].sum(), -i))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of each fingerprint, in order, as a number."""
    u, out = fps.view(np.uint64), np.zeros(len(fps), np.int64)
    for at, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << at
    return out


def near_counts(fps: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """For each group and each of its blocks, a table [value, d]: the share of
    all fingerprints whose block differs from the value in d bits."""
    blocks = [g[a:a + BLOCK_BITS] for g in groups for a in range(0, len(g), BLOCK_BITS)]

    def run(batches):
        counts = np.zeros((len(blocks), 1 << BLOCK_BITS), np.int64)
        for batch in batches:
            f = batch.column(0).to_numpy()
            for i, b in enumerate(blocks):
                counts[i] += np.bincount(values(f, b), minlength=1 << BLOCK_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["i", "n"])

    rows = fps.select("fp").mapInArrow(task(run), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(blocks) << BLOCK_BITS)
    for r in rows:
        counts[r.i] = r.n
    counts = counts.reshape(len(blocks), -1)
    every = np.arange(1 << BLOCK_BITS)
    apart = np.bitwise_count(every[:, None] ^ every)
    tables = [np.stack([(apart == d) @ c for d in range(DEEPEST + 1)], 1) / max(c.sum(), 1) for c in counts]
    per = [-(-len(g) // BLOCK_BITS) for g in groups]
    return [[tables[sum(per[:i]) + j] for j in range(per[i])] for i in range(len(groups))]


def thresholds(fps: np.ndarray, groups: list[list[int]], near: list, n: int, max_bits: int) -> np.ndarray:
    """[fingerprint, group] thresholds that cost least by the estimates."""
    budget = max_bits + 1                    # sum of (t + 1)
    deepest = min(max(DEEPEST, -(-budget // len(groups)) - 1), max_bits)
    best = np.full((budget + 1, len(fps)), np.inf)
    best[0] = 0
    choice = []
    for bits, tables in zip(groups, near):
        v = values(fps, bits)
        share = np.zeros((deepest + 1, len(fps)))
        share[0] = 1
        for j, t in enumerate(tables):       # share of fingerprints d bits apart, block by block
            own = t[(v >> (j * BLOCK_BITS)) & ((1 << BLOCK_BITS) - 1)].T
            share = np.stack([sum(share[d - e] * own[e] for e in range(min(d, DEEPEST) + 1))
                              for d in range(deepest + 1)])
        within = np.cumsum(share, 0) * n
        probes = np.cumsum([_choose(len(bits), d) for d in range(deepest + 1)])
        nxt, took = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for s in range(budget + 1):
            for t in range(-1, min(deepest, s - 1) + 1):
                cost = best[s - t - 1] + (0 if t < 0 else within[t] + probes[t])
                better = cost < nxt[s]
                nxt[s][better], took[s][better] = cost[better], t
        best = nxt
        choice.append(took)
    out = np.zeros((len(fps), len(groups)), np.int64)
    left = np.full(len(fps), budget)
    for i in range(len(groups) - 1, -1, -1):
        out[:, i] = choice[i][left, np.arange(len(fps))]
        left -= out[:, i] + 1
    return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# --- probe and verify --------------------------------------------------------------

def spread(fps: DataFrame, groups: list[list[int]], near: list, n: int, max_bits: int) -> DataFrame:
    """(key, probe, fp): each fingerprint under its value in every group
    (probe 0) and under the values that it probes (probe 1)."""
    masks = [[np.array([sum(1 << b for b in c) for c in itertools.combinations(range(len(g)), d)], np.int64)
              for d in range(max_bits + 1)] for g in groups]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                f = batch.column(0).to_numpy()[at:at + 4096]
                t = thresholds(f, groups, near, n, max_bits)
                keys, kinds, whose = [], [], []
                for i, g in enumerate(groups):
                    v = values(f, g) | i << 32
                    keys.append(v), kinds.append(np.zeros(len(f), np.int8)), whose.append(f)
                    for d in range(int(t[:, i].max(initial=-1)) + 1):
                        some = t[:, i] >= d
                        probe = (v[some][:, None] ^ masks[i][d]).ravel()
                        keys.append(probe), kinds.append(np.ones(len(probe), np.int8))
                        whose.append(np.repeat(f[some], len(masks[i][d])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, kinds, whose)],
                                                 ["key", "probe", "fp"])

    return fps.select("fp").mapInArrow(task(run), "key long, probe byte, fp long")


def edges(rows: DataFrame, max_bits: int, cell: int = CELL) -> DataFrame:
    """(u, v), u < v: edges that join the linked fingerprints of each key."""
    counts = rows.groupBy("key").agg(F.sum(1 - F.col("probe")).alias("own"), F.sum("probe").alias("probes"))
    big = counts.filter((F.col("own") > 0) & ((F.col("own") > cell) | (F.col("probes") > 8 * cell))).select(
        "key", F.ceil(F.col("own") / cell).alias("across"), F.ceil(F.col("probes") / (8 * cell)).alias("down"))
    grid = rows.join(big, "key", "left").withColumn("across", F.coalesce("across", F.lit(1))) \
        .withColumn("down", F.greatest(F.coalesce("down", F.lit(1)), F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("probe") == 0, F.col("across")).otherwise(F.col("down")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("probe") == 0, F.col("down")).otherwise(F.col("across")) - 1))
    cells = grid.withColumn("mine", mine).withColumn("other", other).select(
        "key", F.when(F.col("probe") == 0, F.col("mine")).otherwise(F.col("other")).alias("x"),
        F.when(F.col("probe") == 0, F.col("other")).otherwise(F.col("mine")).alias("y"), "probe", "fp")

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            for u, v in _verify(cols, max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
            last = np.logical_and.reduce([c == c[-1] for c in cols[:3]]) & (cols[3] == 0)
            held = [c[last] for c in cols]        # the last cell may go on; its own rows come first

    return cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "probe", "fp") \
        .mapInArrow(task(run), "u long, v long").distinct()


def _verify(cols: list[np.ndarray], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges between the fingerprints and the probes of each cell (sorted)."""
    probe, fp = cols[3] == 1, cols[4]
    new = np.ones(len(fp), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])
    start = np.flatnonzero(new)
    cell = np.cumsum(new) - 1
    own = np.bincount(cell[~probe], minlength=len(start))
    few = own <= 3
    at = np.flatnonzero(probe & few[cell])
    for nth in range(3):                                     # small cells, all at once
        some = at[own[cell[at]] > nth]
        u, v = fp[some], fp[start[cell[some]] + nth]
        near = (np.bitwise_count((u ^ v).view(np.uint64)) <= max_bits) & (u != v)
        if near.any():
            yield u[near], v[near]
    size = np.diff(np.append(start, len(fp)))
    for c in np.flatnonzero(~few & (size > own)):
        a = start[c]
        yield from _forest(fp[a:a + own[c]], fp[a + own[c]:a + size[c]], max_bits)


def _forest(own: np.ndarray, probes: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that join each probe and the own rows it links to.  Own rows that
    are joined already share a root, which is linked once per probe."""
    root, at, step = np.arange(len(own)), 0, 1
    while at < len(probes):
        p = probes[at:at + step]
        apart = p[:, None] ^ own
        i, j = np.nonzero((np.bitwise_count(apart.view(np.uint64)) <= max_bits) & (apart != 0))
        if len(i):
            link = np.unique(i * len(own) + root[j])
            i, r = link // len(own), link % len(own)
            yield p[i], own[r]
            first = np.zeros(len(i), bool)
            first[0] = True
            first[1:] = i[1:] != i[:-1]
            head = r[np.flatnonzero(first)[np.cumsum(first) - 1]]
            if (head != r).any():
                root = _join(root, head[head != r], r[head != r])
        at += step
        step = min(2 * step, max(1, PAIRS // len(own)))


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining the sets of a[i] and b[i]."""
    parent = np.arange(len(root))
    while True:
        ra, rb = parent[a], parent[b]
        low = np.minimum(ra, rb)
        before = parent.copy()
        np.minimum.at(parent, ra, low)
        np.minimum.at(parent, rb, low)
        parent = parent[parent]
        if (parent == before).all():
            return parent[root]


# --- components --------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(u, v): every node of ``links`` but the smallest of its component, with
    that smallest node.  Large-star and small-star in turn, until nothing
    changes; each round is written to the shared folder."""
    now, before = cut(links), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return now
        before = state


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
               max_bits: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest id that
    links reach, its own included).

    * null, empty and blank texts have fingerprint 0 and are linked like any
      other; texts are read whole;
    * a null id is carried through and never names a component that has ids;
      a component without ids gets null;
    * rows that repeat an id each get a row; other columns are not read;
    * an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n, both = bit_counts(nodes)
    groups = bit_groups(n, both)
    near = near_counts(nodes, groups)
    links = edges(spread(nodes, groups, near, n, max_bits), max_bits)
    stars = components(links)
    members = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of = members.join(named, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")
