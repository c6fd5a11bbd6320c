import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from haat.llm.orchard import Orchard, clusters
from tests.llm import helpers

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2 ** 31), st.integers(1, 30), st.integers(1, 5), st.integers(1, 9))
def test_search_against_all_distances(seed, k, dims, spread):
    rng = np.random.default_rng(seed)
    c, x = rng.integers(-spread, spread, (k, dims)), rng.integers(-spread, spread, (60, dims))
    at, d, met = Orchard(c).nearest(x)
    every = ((x[:, None, :] - c) ** 2).sum(2)
    assert at.tolist() == every.argmin(1).tolist() and d.tolist() == every.min(1).tolist()
    assert (met >= 1).all() and (met <= k).all()


def test_most_distances_are_passed_over():
    rng = np.random.default_rng(3)
    c = rng.integers(-1000, 1000, (200, 8))
    x = c[rng.integers(0, 200, 2000)] + rng.integers(-60, 60, (2000, 8))
    met = Orchard(c).nearest(x)[2]
    print("share of distances computed", met.mean() / 200)
    assert met.mean() < 0.5 * 200


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else m for j, m in enumerate(c)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {}
    for _, j, d in found:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in found]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 6)]) for i in range(200)]
    rows += [(300 + i, rows[20][1]) for i in range(80)] + [(7, rows[8][1]), (7, rows[7][1]), (None, rows[9][1])]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 4), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6),
             (1004, []), (1005, [1.0, 2.0]), (1006, [0.0] * 7)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    got = clusters(df, dims=6).drop("n_compared").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, dims=6), key=key)


def test_few_rows(spark):
    empty = clusters(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 4.0])]
    got = clusters(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), dims=2).drop("n_compared").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, dims=2), key=key)


def test_components_that_would_not_fit(spark):
    for x in (1e30, -1e30, 2.0 ** 20 + 1):
        with pytest.raises(ValueError):
            clusters(spark.createDataFrame([(1, [x, 0.0], "x", 1)], SCHEMA), dims=2)
    assert clusters(spark.createDataFrame([(1, [2.0 ** 20, -2.0 ** 20], "x", 1)], SCHEMA), dims=2).count() == 1


def test_query_against_brute_force(spark):
    from haat.llm.queries import QUERIES
    rows = [(r.vec_id, r.embedding) for r in helpers.read(spark, "embeddings").collect()]
    got = QUERIES["op11_centroids"](spark, helpers.SF).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
