"""Nearest neighbours of every vector against all distances."""

import numpy as np
import pytest

from haat.operators.neighbours import nearest_of_all

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    out = []
    for i, v in rows:
        d = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(w, np.float64)) ** 2).sum())), j)
                   for j, w in rows if j != i)[:k]
        out += [(i, r + 1, j, round(x, 4)) for r, (x, j) in enumerate(d)]
    return sorted(out)


def got(spark, rows, k, dims, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in nearest_of_all(df, k, dims, **kw).collect())


def vectors(rng, n, dims, spread=1.0):
    return [[float(np.float32(x)) for x in rng.normal(0, spread, dims)] for _ in range(n)]


@pytest.mark.parametrize("block_rows, centres", [(4096, 1024), (20, 8), (7, 3)])
def test_against_all_distances(spark, block_rows, centres):
    rng = np.random.default_rng(3)
    rows = list(enumerate(vectors(rng, 180, 5)))
    hot = vectors(rng, 1, 5)[0]
    rows += [(500 + i, hot) for i in range(90)]                   # a third of all rows, equal
    odd = [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5),
           (904, [float("inf")] * 5), (None, [1.0] * 5)]
    want = brute(rows, 4)
    for a, b in zip(got(spark, rows + odd, 4, 5, block_rows=block_rows, max_centres=centres), want):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-4


def test_few_rows_and_repeated_ids(spark):
    assert got(spark, [], 3, 2) == [] and got(spark, [(1, [0.0, 0.0])], 3, 2) == []
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [0.0, 1.0])]
    # Both rows of id 2 are asked for and found; they are not each other's neighbours.
    assert got(spark, rows, 3, 2) == [(1, 1, 2, 1.0), (1, 2, 2, 5.0), (2, 1, 1, 1.0), (2, 1, 1, 5.0)]


def test_bounds_rule_most_blocks_out(spark, monkeypatch):
    """Well separated balls: a vector is asked of few blocks but its own."""
    from haat.operators import neighbours as N
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 100, (12, 4))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, 1, 4)]) for i in range(600)]
    asked = []
    search = N._search
    monkeypatch.setattr(N, "_search", lambda lists, probes, k: (asked.append(
        (lists.select("block").distinct().count(), probes.count())), search(lists, probes, k))[1])
    assert [r[:3] for r in got(spark, rows, 3, 4, block_rows=60)] == [r[:3] for r in brute(rows, 3)]
    (blocks, own), (_, more) = asked
    print("blocks", blocks, "probes beyond the own block", more, "of", own * (blocks - 1))
    assert own == 600 and more < 0.25 * own * (blocks - 1)


def test_probes_of_many_blocks_go_on_in_bounded_parts():
    """Two thousand vectors that may ask 500 blocks each."""
    import pandas as pd
    from haat.operators import neighbours as N
    n, blocks = 2000, 500
    frame = pd.DataFrame({"block": "none", "row": np.arange(n), "vec_id": np.arange(n),
                          "v": list(np.zeros((n, 4))), "t": np.inf})
    of = np.zeros(blocks, int)
    parts = [len(p) for p in N._probes(iter([frame]), np.zeros((1, 4)), np.arange(blocks).astype(str).astype(object), of,
                                       np.zeros(blocks), np.ones(blocks))]
    assert sum(parts) == n * blocks and max(parts) <= N.SENT


def test_equal_vectors_are_cut_into_blocks_too(spark, monkeypatch):
    from haat.operators import neighbours as N
    sizes = []
    search = N._search
    monkeypatch.setattr(N, "_search", lambda lists, probes, k: (sizes.extend(
        r["count"] for r in lists.groupBy("block").count().collect()), search(lists, probes, k))[1])
    rows = [(i, [1.0, 2.0]) for i in range(400)]
    assert [r[:3] for r in got(spark, rows, 2, 2, block_rows=20)] == [r[:3] for r in brute(rows, 2)]
    assert max(sizes) < 60
