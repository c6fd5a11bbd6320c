"""Bootstrap gaps between groups and the quality of recommendations, against
plain Python."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haat.operators import bootstrap as B, recommend_quality as RQ


def poisson(u: float) -> int:
    k, p = 0, math.exp(-1)
    total = p
    while u >= round(total * 65536) and k < 8:
        k += 1
        p /= k
        total += p
    return k


def brute_gaps(rows, replicates):
    out = {}
    weights = {}
    for _, _, key in rows:
        for b in range(replicates // 8):
            h = hashlib.md5(f"{key}|{b}".encode()).hexdigest()
            for i in range(8):
                weights[key, 8 * b + i] = poisson(int(h[4 * i:4 * i + 4], 16))
    for g in {r[0] for r in rows}:
        gaps, ratios = [], []
        for r in range(replicates):
            n, s = [0, 0], [0.0, 0.0]
            for group, y, key in rows:
                if y is not None:
                    n[group != g] += weights[key, r]
                    s[group != g] += weights[key, r] * y
            if n[0] and n[1]:
                a, b = s[0] / n[0], s[1] / n[1]
                gaps.append(a - b)
                if b:
                    ratios.append(a / b)
        own = [y for group, y, _ in rows if group == g and y is not None]
        rest = [y for group, y, _ in rows if group != g and y is not None]
        if own:
            out[g] = (len(own), np.mean(own), np.mean(rest) if rest else None,
                      *([np.quantile(v, p) for p in (0.025, 0.975)] if v else [None] * 2 for v in (gaps, ratios)))
    return out


def gaps(spark, rows, replicates):
    df = spark.createDataFrame(rows, "g string, y double, k string")
    return {r["group"]: r for r in B.group_gaps(df, F.col("g"), F.col("y"), F.col("k"), replicates).collect()}


def test_gaps_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.05 else round(rng.gauss(m, 3), 2), f"r{i}")
            for i, (g, m) in enumerate([("a", 10), ("b", 12), (None, 30)] * 40)] + [("one", 5.0, "r999"), ("none", None, "r998")]
    want, got = brute_gaps(rows, 48), gaps(spark, rows, 48)
    assert set(got) == set(want) == {"a", "b", None, "one"}
    for g, (n, mean, rest, gq, rq) in want.items():
        r = got[g]
        assert r.n_rows == n
        for have, should in ((r["mean"], mean), (r["rest"], rest), (r["gap"], mean - rest), (r["ratio"], mean / rest),
                             (r["gap_low"], gq[0]), (r["gap_high"], gq[1]), (r["ratio_low"], rq[0]), (r["ratio_high"], rq[1])):
            assert have == pytest.approx(should, abs=1e-4)


def test_gaps_of_one_group_and_of_nothing(spark):
    r = gaps(spark, [("a", 1.0, "x"), ("a", 3.0, "y")], 8)["a"]
    assert (r["mean"], r["rest"], r["gap"], r["ratio"], r["gap_low"]) == (2.0, None, None, None, None)
    assert gaps(spark, [], 8) == {}
    with pytest.raises(ValueError):
        gaps(spark, [], 12)


def test_interval_has_the_width_of_the_standard_error(spark):
    """400 + 400 rows: the interval is near +-1.96 standard errors and the
    weights have mean and variance near 1."""
    rng = random.Random(7)
    rows = [(g, rng.gauss(m, 2), f"{g}{i}") for g, m in (("a", 5.0), ("b", 6.0)) for i in range(400)]
    r = gaps(spark, rows, 400)["b"]
    se = math.sqrt(sum(np.var([y for g, y, _ in rows if g == k], ddof=1) / 400 for k in "ab"))
    assert r["gap_high"] - r["gap_low"] == pytest.approx(2 * 1.96 * se, rel=0.15) and r["gap_low"] > 0
    digits = spark.range(20_000).select(B.poisson_weight(F.substring(F.md5(F.col("id").cast("string")), 1, 4)).alias("w"))
    m, v = digits.agg(F.avg("w"), F.var_samp("w")).first()
    assert m == pytest.approx(1, abs=0.04) and v == pytest.approx(1, abs=0.06)


TX = "user_id long, product string, dt date, transaction_id long, quantity int"


def day(n):
    return dt.date(2000, 1, 1) + dt.timedelta(n)


def brute_quality(rows, lists, ks):
    """``lists``: function (train rows) -> function user -> ranked products."""
    known = [r for r in rows if None not in r[:4]]
    orders = {}
    for u, _, d, t, _ in known:
        orders.setdefault(u, set()).add((d, t))
    held = {u: max(o)[1] for u, o in orders.items() if len({t for _, t in o}) > 1}
    train = [r for r in known if held.get(r[0]) != r[3]]
    of = lists(train)
    out = {}
    for k in ks:
        hits, recall, ndcg = 0, [], []
        for u, t in held.items():
            want = {r[1] for r in known if r[0] == u and r[3] == t}
            ranks = [i for i, p in enumerate(of(u)[:k], 1) if p in want]
            hits += len(ranks)
            recall.append(len(ranks) / len(want))
            ndcg.append(sum(1 / math.log2(i + 1) for i in ranks) / sum(1 / math.log2(i + 1) for i in range(1, min(k, len(want)) + 1)))
        out[k] = (len(held), hits, np.mean(recall), np.mean(ndcg))
    return out


def popular(train):
    n = {}
    for r in train:
        n[r[1]] = n.get(r[1], 0) + 1
    found = sorted(n, key=lambda p: (-n[p], p))
    return lambda u: found


def history(train):
    n = {}
    for u, p, _, _, q in train:
        n.setdefault(u, {}).setdefault(p, 0)
        n[u][p] += q
    return lambda u: sorted(n.get(u, {}), key=lambda p: (-n[u][p], p))


def purchases(seed, users=40, tastes=False):
    rng = random.Random(seed)
    rows, t = [], 0
    for u in range(users):
        for _ in range(rng.randint(1, 6)):
            t += 1
            d = day(rng.randint(0, 9))
            for _ in range(rng.randint(1, 4)):
                p = f"p{(u % 4) * 3 + rng.randint(0, 2)}" if tastes else f"p{min(rng.randint(0, 9), rng.randint(0, 9))}"
                rows.append((u, p, d, t, rng.randint(1, 3)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_against_plain_python(spark, seed):
    rows = purchases(seed) + [(None, "p1", day(99), 9001, 1), (3, None, day(99), 9002, 1), (3, "p1", None, 9003, 1)]
    rows += [(77, "p9", day(1), 9100 + i // 400, 1) for i in range(800)]          # a hot user
    got = {(r.model, r.k): r for r in RQ.compare_lists(spark.createDataFrame(rows, TX), (1, 3, 5)).collect()}
    assert len(got) == 6
    for name, lists in (("popular", popular), ("history", history)):
        for k, (users, hits, recall, ndcg) in brute_quality(rows, lists, (1, 3, 5)).items():
            r = got[name, k]
            assert (r.n_users, r.n_hits) == (users, hits)
            assert r.recall == pytest.approx(recall, abs=1e-4) and r.ndcg == pytest.approx(ndcg, abs=1e-4)


def test_nothing_of_the_held_out_order_is_learned(spark):
    rows = purchases(3)
    train, test = RQ.holdout(spark.createDataFrame(rows, TX))
    last = {}
    for u, _, d, t, _ in rows:
        last[u] = max(last.get(u, (d, t)), (d, t))
    several = {u for u in last if len({r[3] for r in rows if r[0] == u}) > 1}
    assert {(r.user_id, r.product) for r in test.collect()} == {(r[0], r[1]) for r in rows if r[0] in several and r[3] == last[r[0]][1]}
    assert sorted(r.transaction_id for r in train.collect()) == sorted(
        r[3] for r in rows if r[0] not in several or r[3] != last[r[0]][1])
    empty = spark.createDataFrame([], TX)
    assert RQ.compare_lists(empty).count() == 0


def test_als_finds_tastes_that_popularity_misses(spark):
    tx = spark.createDataFrame(purchases(4, 80, tastes=True), TX)
    got = {(r.model, r.k): r for r in RQ.als_quality(tx, (1, 3), rank=6, max_iter=8, blocks=2).collect()}
    assert got["als", 3].n_users == got["popular", 3].n_users
    assert got["als", 3].recall > 1.5 * got["popular", 3].recall and got["als", 3].ndcg > got["popular", 3].ndcg


def test_als_quality_reads_its_rows_once(spark):
    import datetime as dt
    rows = [(u, f"p{(u + o) % 4}", dt.date(2024, 1, 1 + o), 10 * u + o, 1) for u in range(12) for o in range(3)]
    tx = spark.createDataFrame(rows, "user_id long, product string, dt date, transaction_id long, quantity int")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    assert RQ.als_quality(tx.mapInArrow(counted, tx.schema), (1, 3), rank=2, max_iter=2, blocks=2).count() == 4
    assert read.value == len(rows)
