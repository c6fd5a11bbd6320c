"""SimHash near-dedup and line dedup against brute force."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from haat.llm import simhash
from haat.llm.line_dedup import common_blocks, line_dedup, patience, rewritten
from tests.llm import helpers

LINKED = 3


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, bits=LINKED):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    u = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= bits):
            parent[root(fps[i + 1 + int(j)])] = root(f)
    least = defaultdict(list)
    for i, f in rows:
        if i is not None:
            least[root(f)].append(i)
    return {f: min(least[root(f)], default=None) for f in fps}


def test_fingerprints():
    for t in helpers.ODD_TEXTS + ["One two THREE four", "Ä B c D e", "a b c " * 500]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_components_of_a_table(spark):
    docs = helpers.read(spark, sf="/root/testdata/sf0.01")
    got = simhash.near_dedup(docs).collect()
    rows = [(r.doc_id, r.fp % 2 ** 64) for r in got]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(slow_fingerprint(texts[i]) == f for i, f in rows[::10])
    want = slow_components(rows)
    assert all(r.component_id == want[r.fp % 2 ** 64] for r in got)


@pytest.mark.parametrize("cell", [8192, 5])
def test_dense_balls_and_chains(spark, cell):
    """Thousands of fingerprints around few centres, chains of distance 3, and
    pairs just beyond; also with cells so small that they are split."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(4):
        centre = int(rng.integers(0, 2 ** 63))
        for _ in range(150):
            f = centre
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    f = int(rng.integers(0, 2 ** 63))
    for i in range(40):                       # each 3 or 4 bits from the last
        for b in rng.choice(64, 3 + (i % 4 == 0), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 2 ** 63, 500)} | {0, 7, 15}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in rows], "doc_id long, fp long")
    n, both = simhash.bit_counts(df)
    assert n == len(rows)
    groups = simhash.bit_groups(n, both)
    assert sorted(b for g in groups for b in g) == list(range(64))
    near = simhash.near_counts(df, groups)
    spread = simhash.spread(df, groups, near, n, LINKED)
    links = simhash.edges(spread, LINKED, cell)
    stars = {r.u % 2 ** 64: r.v % 2 ** 64 for r in simhash.components(links).collect()}
    want = slow_components(rows)
    first = {f: i for i, f in rows}
    mine = defaultdict(list)
    for f in fps:
        mine[stars.get(f, f)].append(f)
    got = {f: min(first[x] for x in fs) for fs in mine.values() for f in fs}
    assert got == want
    # a spanning forest, not all pairs
    assert links.count() < spread.count()


def test_thresholds_obey_the_pigeonhole():
    rng = np.random.default_rng(1)
    fps = rng.integers(-2 ** 62, 2 ** 62, 200)
    groups = [list(range(22)), list(range(22, 43)), list(range(43, 64))]
    near = [[np.abs(rng.normal(size=(2048, 3))) for _ in range(2)] for _ in groups]
    for bits in (0, 1, 2, 3, 5):
        t = simhash.thresholds(fps, groups, near, 1000, bits)
        assert (t.sum(1) == bits - 2).all() and t.min() >= -1


def test_near_dedup_edges(spark):
    assert simhash.near_dedup(helpers.empty(spark)).count() == 0
    docs = helpers.with_null_and_repeats(spark)
    got = simhash.near_dedup(docs).collect()
    want = slow_components([(r.doc_id, r.fp % 2 ** 64) for r in got])
    assert len(got) == docs.count() and all(r.component_id == want[r.fp % 2 ** 64] for r in got)
    assert {r.component_id for r in got if r.fp == 0} == {1}


# --- line dedup --------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if set(a) & set(b):
        assert pairs
    if a == b:
        assert len(pairs) == len(a)


def entries(keys, words=3):
    return [(i, k, words, 2 * i) for i, k in enumerate(keys)]


def test_blocks_and_moved_blocks():
    assert common_blocks(entries("xABCy"), entries("ABC"), 9) == [2, 4, 6]
    assert common_blocks(entries("xABCy"), entries("ABC"), 10) == []
    assert common_blocks(entries("CDEF AB"), entries("AB CDEF"), 6) == [0, 2, 4, 6, 10, 12]
    assert common_blocks(entries("ABxAB"), entries("AB"), 6) == [0, 2, 6, 8]     # twice in the later one


def slow_line_dedup(rows, min_words, rare):
    """The stated rules with dictionaries, all pairs of each line in memory."""
    docs = {}
    for i, t in rows:
        docs[i] = [(s, line.strip(), len(line.split()), p) for s, (p, line) in
                   enumerate((p, x) for p, x in enumerate(t.split("\n")) if x.split())]
    holders = defaultdict(set)
    for i, ls in docs.items():
        for x in ls:
            holders[x[1]].add(i)
    gone = defaultdict(set)
    for i, ls in docs.items():
        shared = [x for x in ls if len(holders[x[1]]) > 1]
        for home in {min(holders[x[1]]) for x in shared if len(holders[x[1]]) <= rare} - {i}:
            other = [x for x in docs[home] if len(holders[x[1]]) > 1]
            gone[i].update(common_blocks(shared, other, min_words))
        for home in {min(holders[x[1]]) for x in shared if len(holders[x[1]]) > rare} - {i}:
            mine = [x for x in shared if min(holders[x[1]]) == home and len(holders[x[1]]) > rare]
            other = [x for x in docs[home] if x[1] in {y[1] for y in mine}]
            gone[i].update(common_blocks(mine, other, min_words))
    return {i: sorted(gone[i]) for i in docs}


@pytest.mark.parametrize("rare", [32, 3])
def test_line_dedup_of_a_table(spark, rare):
    docs = helpers.read(spark, sf="/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in line_dedup(docs, rare=rare).collect()}
    want = slow_line_dedup(rows, 5, rare)
    assert {i: r.deleted for i, r in got.items()} == want
    first = {}
    for i, t in sorted(rows):
        for line in t.split("\n"):
            first.setdefault(line.strip(), i)
    for i, t in rows:
        kept = got[i].dedup_text.split("\n") if got[i].dedup_text else []
        assert kept == [x for p, x in enumerate(t.split("\n")) if p not in want[i]] or not kept
        for p in want[i]:                        # what goes stands in an earlier document, and stays there
            line = t.split("\n")[p].strip()
            assert first[line] < i
            assert line in [x.strip() for x in got[first[line]].dedup_text.split("\n")]
        for line in t.split("\n"):               # long passages stand in one document only
            if len(line.split()) > 50 and first[line.strip()] != i:
                assert line not in kept
        assert i >= 0 and all(e < i for e in got[i].earlier)


def test_line_dedup_edges(spark):
    assert line_dedup(helpers.empty(spark)).count() == 0
    docs = helpers.with_null_and_repeats(spark)
    got = line_dedup(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.text is None) == (r.dedup_text is None)
        if r.doc_id is None:
            assert r.dedup_text == r.text
    texts = ["one two three four five\nA b", "X y z\n one two three four five \n\nend", "one two three four five",
             "one two three four five"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, deleted string")
    out = {r.doc_id: r for r in line_dedup(df).collect()}
    assert [out[i].deleted for i in range(4)] == [[], [1], [0], [0]]
    assert out[1].dedup_text == "X y z\n\nend" and out[1].earlier == [0]
    kept = rewritten(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1] and kept.columns == df.columns


def whole_blocks(rows, min_words=5):
    """Positions of lines in runs of ``min_words`` words that an earlier
    document holds too, from all runs of all documents; no alignment."""
    gone, seen = {}, set()
    for i, t in sorted(rows):
        ls = [(p, x.strip()) for p, x in enumerate(t.split("\n")) if x.split()]
        runs = {(a, b) for a in range(len(ls)) for b in range(a + 1, len(ls) + 1)
                if sum(len(x.split()) for _, x in ls[a:b]) >= min_words}
        gone[i] = sorted({p for a, b in runs if tuple(x for _, x in ls[a:b]) in seen for p, _ in ls[a:b]})
        seen |= {tuple(x for _, x in ls[a:b]) for a, b in runs}
    return gone


def test_common_blocks_go_whole(spark):
    """40 copies of blocks with short lines that earlier documents hold alone."""
    alone = ["Les.\nun deux", "And.\ntrois", "so it\nquatre cinq", "six\nwent on"]
    blocks = ["Alpha beta\nLes.\nGamma delta", "so it\n\nwent on\nAnd.", "One long line of seven words here\nAnd."]
    copies = [f"own {i}\n" + "\n".join(f"{b}\nof {i} {n}" for n, b in enumerate(blocks)) for i in range(40)]
    rows = list(enumerate(alone + copies))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = whole_blocks(rows)
    assert want[20] == [1, 2, 3, 5, 7, 8, 10, 11]
    unsplit = slow_line_dedup(rows, 5, 10 ** 9)
    for rare in (32, 3, 1000):
        got = {r.doc_id: r.deleted for r in line_dedup(df, rare=rare).collect()}
        assert got == want and all(set(unsplit[i]) <= set(got[i]) for i in got)
