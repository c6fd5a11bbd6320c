import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from haat.llm import topk
from haat.llm.topk import Block, choose_pivots, to_pivots, top_k


def brute(rows, k, every=20):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            s = sorted((-sum(x * y for x, y in zip(q, w)), j) for b, (j, w) in enumerate(kept) if a != b)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("blocks", [8192, 40])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6)], 0) for i in range(300)]
    rows += [(300 + i, rows[20][1], 0) for i in range(150)]                      # a third alike: ties
    rows += [(1000, None, 0), (1020, [1.0, None], 0), (1040, [float("nan")] * 6, 0), (1060, [float("inf")] * 6, 0),
             (1080, [], 0), (1100, [1.0, 2.0], 0), (None, [1.0] * 6, 0)]
    rows += [(40, rows[41][1], 0), (7, [9.0] * 6, 0), (7, rows[7][1], 0)]        # repeated ids
    got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=blocks)
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:2] for r in rows], 20)


def test_few_rows(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)).count() == 0
    rows = [(20, [1.0], 0), (21, [2.0], 0)]
    assert [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA)).collect()] == [(20, 1, 21, 8192)]
    rows = [(20, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [5.0, 0.0], 0), (2, [2.0, 0.0], 0)]
    assert [r.score for r in top_k(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()] == [20480, 8192, 4096]


def test_components_that_would_not_fit(spark):
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(20, [1e30], 0)], SCHEMA))
    big = [(20, [2.0 ** 20, -2.0 ** 20], 0), (21, [2.0 ** 20 - 1, 2.0 ** 19], 0), (22, [-2.0 ** 20, 1.0], 0)]
    got = top_k(spark.createDataFrame(big, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:2] for r in big], 20)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 31), st.integers(1, 400), st.integers(1, 5), st.integers(1, 12), st.integers(1, 60))
def test_elimination_loses_nothing(seed, n, dims, k, leaf):
    rng = np.random.default_rng(seed)
    m = rng.integers(-6, 7, (n, dims))
    piv = to_pivots(m, choose_pivots(m.astype(float), 4))
    ids = rng.permutation(n)
    before, topk.LEAF = topk.LEAF, leaf
    try:
        at, found, s = Block(np.arange(n), ids, m, piv).search(np.arange(n)[:5], m[:5], piv[:5], np.full(min(n, 5), -np.inf), k)
    finally:
        topk.LEAF = before
    for q in range(min(n, 5)):
        want = sorted((-int(m[j] @ m[q]), int(ids[j])) for j in range(n) if j != q)[:k]
        assert [(-x, i) for a, i, x in zip(at, found.tolist(), s.tolist()) if a == q] == want


def test_most_candidates_are_passed_over(monkeypatch):
    """Vectors in balls of one length: bounds leave few leaves to evaluate."""
    monkeypatch.setattr(topk, "LEAF", 64)
    rng = np.random.default_rng(1)
    c = rng.normal(0, 1, (40, 16))
    c = c / np.sqrt((c ** 2).sum(1))[:, None]
    m = np.floor(64 * (10 * c[rng.integers(0, 40, 8000)] + rng.normal(0, 0.1, (8000, 16)))).astype(np.int64)
    piv = to_pivots(m, choose_pivots(m[:1000].astype(float), 64))
    block = Block(np.arange(8000), np.arange(8000), m, piv)
    block.search(np.arange(200), m[:200], piv[:200], np.full(200, -np.inf), 20)
    print("share evaluated", block.evaluated / (200 * 8000))
    assert block.evaluated < 0.25 * 200 * 8000
