"""Exact dedup, sharding, mixing and license scans on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from haat.llm.common import id_bucket, ranked
from haat.llm.exact_dedup import exact_dedup
from haat.llm.licenses import NOTICES, scan
from haat.llm.mixing import mix
from haat.llm.sharding import longest_first, shard
from tests.llm import helpers


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("same")])
def test_exact_dedup(spark, digest):
    """Also with digests so weak that texts share them."""
    docs = helpers.with_null_and_repeats(spark)
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 100).withColumn("text", F.concat(F.lit("\t"), "text")))
    kw = {} if digest is None else {"digest": digest}
    got = exact_dedup(docs, **kw)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute_groups(rows)
    if digest is None:
        want = Counter(hashlib.sha256(norm(t).encode()).hexdigest() for _, t in rows)
        assert Counter(r.digest for r in got.collect()) == want
    assert exact_dedup(helpers.empty(spark)).count() == 0


def test_exact_dedup_is_native(spark):
    plan = exact_dedup(helpers.documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_longest_first():
    sizes = [(i, s) for i, s in enumerate([9, 8, 7, 6, 5, 5, 4, 1])]
    placed = longest_first(sizes, 3)
    load = Counter()
    for k, s in sizes:
        load[placed[k]] += s
    assert sorted(load.values()) == [14, 14, 17]


def check_shards(rows, texts, n):
    where = defaultdict(set)
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        where[texts[r.doc_id] or ""].add(r.shard)
        assert 0 <= r.shard < n
    assert all(len(s) == 1 for s in where.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append((r.slot, r.doc_id))
    for s in slots.values():
        assert [x[0] for x in sorted(s)] == list(range(len(s)))


def test_sharding(spark):
    docs = helpers.read(spark, sf="/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = shard(docs).collect()
    check_shards(rows, texts, 16)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) < 1.02 * min(load.values())


def test_sharding_edges(spark):
    assert shard(helpers.empty(spark)).count() == 0
    docs = helpers.documents(spark)
    check_shards(shard(docs, n_shards=3, units_per_shard=2).collect(), {r.doc_id: r.text for r in docs.collect()}, 3)
    rows = shard(helpers.with_null_and_repeats(spark)).collect()
    assert len(rows) == 2 * len(helpers.ODD_TEXTS) + 1 and any(r.doc_id is None for r in rows)


def brute_edf(shares, period, slots):
    """Slot by slot with releases and deadlines of the endless schedule."""
    had = {s: 0 for s in shares}
    out = []
    for t in range(slots):
        ready = [((had[s] * period + period + a - 1) // a, s) for s, a in shares.items() if had[s] * period // a <= t]
        due, s = min(ready)
        assert t < due
        out.append((s, had[s]))
        had[s] += 1
        for x, a in shares.items():
            assert abs(had[x] - a * (t + 1) / period) < 1
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1}, {"a": 0.7, "b": 0.2, None: 0.1}])
def test_mixing(spark, weights):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mix(docs, weights=weights, period=40, block_docs=3).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    shares = {r.source or "": r.mix_share for r in got}
    assert sum(shares.values()) == 40
    slot = {(r.source or "", r.mix_block): r.mix_slot for r in got}
    want = brute_edf(shares, 40, max(slot.values()) + 1)
    present = [x for x in want if x in slot]
    assert [want.index(x) for x in present] == [slot[x] for x in present]
    position = {(r.source or "", r.mix_block): r.mix_position for r in got}
    assert [position[x] for x in present] == list(range(len(position)))
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
    for s in shares:
        mine = sorted(((r.mix_block, r.mix_place), r.doc_id) for r in got if (r.source or "") == s)
        assert [x[1] for x in mine] == sorted(x[1] for x in mine)
        assert [x[0] for x in mine] == [(i // 3, i % 3) for i in range(len(mine))]


def test_mixing_edges(spark):
    assert mix(helpers.empty(spark)).count() == 0
    docs = helpers.with_null_and_repeats(spark)
    got = mix(docs)
    assert got.count() == docs.count() and got.schema["mix_slot"].dataType.simpleString() == "bigint"
    assert set(docs.columns) <= set(got.columns)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
                          ("mit license", "mit")):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], \
        ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    mit = next(t for t, x in NOTICES.items() if x == "mit").split()
    changed = " ".join(mit[:10] + ["quite", "new"] + mit[10:25] + mit[26:])
    texts = helpers.ODD_TEXTS + [
        "MIT License", "the MIT-License. mit license mit license", "CC BY 4.0 and GNU General Public License",
        "apache mit license apache license", "gnu general public", "license mit", "cc", "Kmit license", changed,
        " ".join(mit[:8]), "mit license " * 2000]
    docs = helpers.documents(spark, texts)
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i + 1]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[texts.index(changed) + 1].labels == "mit" and got[texts.index(changed) + 1].n_base == 0
    assert got[texts.index(" ".join(mit[:8])) + 1].labels == ""
    assert scan(helpers.empty(spark)).count() == 0
    assert scan(helpers.with_null_and_repeats(spark)).count() == 2 * len(helpers.ODD_TEXTS) + 1


def clumps(n):
    """Ids in far-apart clumps, with both ends of the long range, nulls and repeats."""
    ids = list(range(n)) + [10 ** 12 + 7 * i for i in range(n)] + [-10 ** 15 + i * i for i in range(n)]
    return ids + [2 ** 60, 2 ** 63 - 1, -2 ** 63] + [None] * 9 + [5] * 40


def test_id_buckets_stay_even_beside_far_ids(spark):
    ids = clumps(3000)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    got = df.select("id", id_bucket(df, "id", 100).alias("b")).collect()
    sizes = Counter(r.b for r in got)
    assert sizes.pop(-1) == 9
    assert max(sizes.values()) <= 500 and 45 <= len(sizes) <= 300
    got = sorted((r.id, r.b) for r in got if r.id is not None)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))
    few = spark.createDataFrame([(None,), (3,), (2 ** 60,)], "id long")
    assert few.select(id_bucket(few, "id", 100).alias("b")).distinct().count() <= 4
    none = few.filter("id is null")
    assert {r.b for r in none.select(id_bucket(none, "id", 100).alias("b")).collect()} == {-1}


def test_ranked_beside_far_ids(spark):
    ids = clumps(500)
    rows = [("hot" if k % 3 else f"s{k % 7}", i) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "part string, id long").repartition(4)
    got = {}
    for r in ranked(df, "part", "id", "rank", rows_per_bucket=20).collect():
        got.setdefault(r.part, {})[r["rank"]] = r.id
    for part in {p for p, _ in rows}:
        want = sorted((i for p, i in rows if p == part), key=lambda i: (i is not None, i))
        assert [got[part][k] for k in range(len(want))] == want
