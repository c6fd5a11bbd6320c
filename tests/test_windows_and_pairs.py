"""Trailing distinct counts and co-purchase pairs against brute force."""

import datetime as dt
import glob
import math
import os
import random
import subprocess
import sys
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from haat.operators import copurchase as CP
from haat.operators.customers_window import customers_trailing


def trailing(rows, days):
    out = {}
    for p in {r[0] for r in rows if r[1] and r[2] is not None}:
        seen = [(d, u) for q, d, u in rows if q == p and d and u is not None]
        lo, hi = min(d for d, _ in seen), max(d for d, _ in seen)
        for i in range((hi - lo).days + 1):
            day = lo + dt.timedelta(i)
            out[(p, day)] = len({u for d, u in seen if day - dt.timedelta(days) < d <= day})
    return out


@pytest.mark.parametrize("days", [1, 7, 30])
def test_trailing_distinct(spark, days):
    rng = random.Random(days)
    day0 = dt.date(1996, 2, 20)
    users = [0, 1, 2, 3, 32768, 32769, 70000, 10 ** 12]           # several buckets
    rows = [(p, day0 + dt.timedelta(rng.choice([0, 1, 2, 40, 41, 75, 200]) + rng.randrange(12)), rng.choice(users))
            for p in ("a", "b") for _ in range(60)]
    rows += [("lone", day0, 5), ("a", None, 9), ("a", day0, None)]
    df = spark.createDataFrame(rows, "product string, dt date, user_id long")
    got = {(r.product, r.dt): r.customers for r in customers_trailing(df, days).collect()}
    assert got == trailing(rows, days)


def test_trailing_distinct_of_nothing(spark):
    assert customers_trailing(spark.createDataFrame([], "product string, dt date, user_id long")).count() == 0


def pairs(edges):
    items = {}
    for i, u in set(edges):
        if i is not None and u is not None:
            items.setdefault(i, set()).add(u)
    return {(a, b): len(items[a] & items[b]) for a in items for b in items if a < b and items[a] & items[b]}


@pytest.mark.parametrize("block", [256, 4, 1])
def test_pairs_with_a_hot_user(spark, block):
    rng = random.Random(block)
    edges = [(rng.randrange(40), rng.randrange(30)) for _ in range(150)]
    edges += [(i, 99) for i in range(40)] * 2                      # one user with all products, twice
    edges += [(None, 1), (1, None)]
    df = CP.purchases(spark.createDataFrame(edges, "product int, user_id int"))
    got = {(r.a, r.b): r.both for r in CP.pair_counts(df, block).collect()}
    assert got == pairs(edges)


def test_a_hot_users_pairs_land_in_many_keys(spark, monkeypatch):
    """No join key holds more than about block x block pairs."""
    keys = []
    frame = type(spark.range(1))
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how) if how else join(self, other, on)
        if on == ["user", "i", "j"]:
            keys.extend(out.select("i", "j", (F.size("x") * F.size("y")).alias("n")).collect())
        return out

    monkeypatch.setattr(frame, "join", counted)
    df = spark.createDataFrame([(i, 7) for i in range(600)], "item int, user int")
    assert CP.pair_counts(df, 50).count() == 600 * 599 // 2
    assert len(keys) == 12 * 11 // 2 == len({(r.i, r.j) for r in keys}) and max(r.n for r in keys) <= (2 * 50) ** 2


def test_neighbours_by_cosine(spark):
    edges = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2), ("c", 3), ("d", 4)]
    df = spark.createDataFrame(edges, "item string, user int")
    got = [tuple(r) for r in CP.copurchase_neighbours(df, 1).orderBy("item").collect()]
    assert got == [("a", 1, "b", 2, pytest.approx(1.0)), ("b", 1, "a", 2, pytest.approx(1.0)), ("c", 1, "a", 1, 0.5)]
    assert CP.copurchase_neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, hot", [(256, 50_000), (3, 50_000), (4, 2)])
def test_neighbours_send_blocks_and_no_pairs(spark, monkeypatch, block, hot):
    """Against all pairs; hot users, hot items and sizes over a byte included."""
    import math
    import random
    monkeypatch.setattr(CP, "pair_counts", None)
    rnd = random.Random(4)
    edges = {(f"p{rnd.randrange(25)}", rnd.randrange(30)) for _ in range(200)}
    edges |= {(f"p{i}", 7) for i in range(25)} | {("p3", u) for u in range(150)}
    of: dict = {}
    for item, user in edges:
        of.setdefault(item, set()).add(user)
    want = []
    for a in of:
        near = sorted((-len(of[a] & of[b]) / math.sqrt(len(of[a]) * len(of[b])), -len(of[a] & of[b]), b)
                      for b in of if b != a and of[a] & of[b])[:3]
        want += [(a, r + 1, b, -n, pytest.approx(-c)) for r, (c, n, b) in enumerate(near)]
    df = spark.createDataFrame(sorted(edges), "item string, user int")
    got = sorted(tuple(r) for r in CP.copurchase_neighbours(df, 3, block, hot).collect())
    assert got == sorted(want, key=lambda r: r[:2])


def _nearest_by_hand(of, k):
    want = []
    for a in of:
        near = sorted((-len(of[a] & of[b]) / math.sqrt(len(of[a]) * len(of[b])), -len(of[a] & of[b]), b)
                      for b in of if b != a and of[a] & of[b])[:k]
        want += [(a, r + 1, b, -n, pytest.approx(-c)) for r, (c, n, b) in enumerate(near)]
    return sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("block, hot", [(256, 50_000), (3, 10)])
def test_neighbours_disk_is_that_of_one_round(spark, monkeypatch, tmp_path, block, hot):
    """A round's arrays are gone before the next one begins, and at the end
    only the numbered products and the nearest are kept."""
    rnd = random.Random(7)
    edges = {(f"p{rnd.randrange(40)}", rnd.randrange(25)) for _ in range(300)}
    of: dict = {}
    for item, user in edges:
        of.setdefault(item, set()).add(user)
    d = Counter(user for _, user in edges)
    n_pairs = sum(n * n for n in d.values())
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    folders = [f.getPath() for f in disk.localDirs()]

    def shuffled():
        return {p for f in folders for p in glob.glob(f"{f}/*/shuffle_*")}

    df = spark.createDataFrame(sorted(edges), "item string, user int")
    before, left, counted = shuffled(), [], CP._counted

    def at_round(k):
        until = time.time() + 10
        while (now := shuffled() - before) and time.time() < until:
            time.sleep(0.1)             # files go in the background
        left.append(now)
        return counted(k)

    monkeypatch.setattr(CP, "_counted", at_round)
    monkeypatch.setattr(CP, "scratch_dir", lambda _, name: str(tmp_path / name))
    out = CP.copurchase_neighbours(df, 3, block, hot, pairs_per_round=n_pairs // 6, pairs_per_edge=1)
    assert len(left) == math.ceil(n_pairs / max(n_pairs // 6, len(edges))) > 3 and not any(left)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["degrees", "items", "nearest", "sizes"]
    assert spark.conf.get(CP.CLEANUP, None) is None
    assert sorted(tuple(r) for r in out.collect()) == _nearest_by_hand(of, 3)


def test_neighbours_of_a_product_that_goes_on_in_later_batches(monkeypatch):
    """Few pairs at once, products over several batches, ties, products alone."""
    monkeypatch.setattr(CP, "AT_ONCE", 5)
    monkeypatch.setattr(CP, "ROWS", 2)
    rnd = random.Random(9)
    of: dict = {}
    for _ in range(90):
        of.setdefault(rnd.randrange(12), set()).add(rnd.randrange(14))
    of[50] = {99}
    held: dict = {}
    for item, users in of.items():
        for u in users:
            held.setdefault(u, []).append(item)
    rows = [{"id": i, "size": len(of[i]), "o": held[u], "s": [len(of[x]) for x in held[u]]}
            for i in sorted(of) for u in sorted(of[i])]
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("o", pa.list_(pa.int64())), ("s", pa.list_(pa.int64()))])
    batches = [pa.RecordBatch.from_pylist(rows[a:a + 7], schema) for a in range(0, len(rows), 7)]
    for k in (1, 3, 20):
        got = [tuple(r.values()) for b in CP._counted(k)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == _nearest_by_hand(of, k)
    assert [*CP._counted(3)(iter([]))] == []
    assert [b.num_rows for b in CP._counted(3)(iter([batches[0].slice(0, 0)]))] in ([], [0])


def test_tasks_that_count_pairs_need_no_package(tmp_path):
    (tmp_path / "run").write_bytes(cloudpickle.dumps(CP._counted(3)))
    code = "import pickle; print([*pickle.load(open('run', 'rb'))(iter([]))])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.stdout.strip() == "[]", found.stderr
