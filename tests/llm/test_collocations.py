import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from haat.llm import collocations as C
from tests.llm import helpers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [p for p in ([w for w in re.split("[ \t]", piece) if w]
                        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))) if p]


def brute(rows, least, top=2000, longest=5, pct=100):
    out = []
    for lang in {x or "und" for x, _ in rows}:
        f, n = Counter(), 0
        for x, text in rows:
            if (x or "und") == lang:
                for w in split(text):
                    n += len(w)
                    f.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= pct * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(df, least, **kw):
    return sorted(tuple(r) for r in C.collocations(df, min_count=least, **kw).collect())


SCHEMA = "doc_id long, text string, lang string, rank int, phrase string, n double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, x, 1, "p", 0.5) for i, (x, t) in enumerate(rows)], SCHEMA).repartition(parts)


def random_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "B", "the", "of", "é", "x" * 70, "y" * 150, "日本", "c'd", " z"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]
    return [([None, "en", "und", "fr"][int(rng.integers(4))],
             "".join(words[int(rng.integers(len(words)))] + seps[int(rng.integers(len(seps)))]
                     for _ in range(int(rng.integers(0, 40))))) for _ in range(n)]


@pytest.mark.parametrize("seed, least, kw", [
    (1, 3, {}), (2, 8, {}), (3, 5, {"top": 4}), (4, 4, {"contained_pct": 60}), (5, 5, {"max_words": 2}),
    (6, 6, {"max_words": 3, "sample_every": 1}), (7, 4, {"sample_least": 9}), (7, 4, {"sample_least": 9, "FEW": 0})])
def test_against_brute_force(spark, monkeypatch, seed, least, kw):
    monkeypatch.setattr(C, "FEW", kw.pop("FEW", C.FEW))
    rows = random_rows(seed)
    want = brute(rows, least, kw.get("top", 2000), kw.get("max_words", 5), kw.get("contained_pct", 100))
    assert mined(frame(spark, rows), least, **kw) == want and want


def test_border_failures_lead_to_further_passes(spark, monkeypatch):
    """A sample that guesses nothing: every length needs a pass of its own, or
    where failures count as few, one pass for all."""
    passes = []
    count = C._count
    monkeypatch.setattr(C, "_count", lambda *a: (passes.append(a[1]), count(*a))[1])
    rows = [("en", "one two three four five six")] * 9
    assert mined(frame(spark, rows), 9, sample_least=10 ** 6) == brute(rows, 9)
    assert len(passes) == 2 + 5
    passes.clear()
    monkeypatch.setattr(C, "FEW", 0)
    assert mined(frame(spark, rows), 9, sample_least=10 ** 6) == brute(rows, 9)
    assert len(passes) == 2 + 2
    passes.clear()
    assert mined(frame(spark, rows), 9, sample_every=1) == brute(rows, 9)
    assert len(passes) == 2 + 1


def test_odd_rows(spark):
    odd = [("en" if i % 3 else None, t) for i, t in enumerate(helpers.ODD_TEXTS)] * 3
    assert mined(frame(spark, odd), 3) == brute(odd, 3)
    rows = helpers.with_null_and_repeats(spark)
    assert mined(rows, 2) == brute([(r.lang, r.text) for r in rows.collect()], 2)
    assert mined(helpers.empty(spark), 1) == []
    assert mined(frame(spark, [("en", None), (None, ""), ("fr", "one")]), 1) == []


def test_a_hot_phrase_and_a_very_long_text(spark):
    rows = [("en", "of the " * 20_000), ("en", "of the end. " * 3)] + [("fr", "of the")] * 500
    assert mined(frame(spark, rows), 100) == brute(rows, 100)


def test_large_numbers_stay_exact(spark, monkeypatch):
    """1000 a n passes 64 bits."""
    big = 10 ** 13
    table = spark.createDataFrame(
        [("en", 0, "", big), ("en", 1, "a", 10 ** 7 + 3), ("en", 1, "b", 10 ** 7 + 9), ("en", 2, "a b", 10 ** 7 + 1)],
        "lang string, k int, phrase string, a long")
    monkeypatch.setattr(C, "frequent_phrases", lambda *a, **k: table)
    r = C.collocations(table).first()
    assert r.score == 1000 * (10 ** 7 + 1) * big // ((10 ** 7 + 3) * (10 ** 7 + 9))


def test_phrases_that_share_a_hash_are_kept_apart():
    """Hashes cut to a few values: what shares one is handed on as a row."""
    rows = random_rows(9, 30)
    seen, got = C.Seen(), Counter()
    for a in range(0, 30, 10):
        w = C.Words([t for _, t in rows[a:a + 10]], ["en"] * 10)
        for k in (1, 2, 3):
            h, ok = w.hashes(k)
            at = np.flatnonzero(ok)
            for lang, j, phrase, n in seen.add(w, k, h[at] % np.uint64(7), at):
                got[(j, phrase)] += n
    for lang, j, phrase, n in seen.rows():
        got[(j, phrase)] += n
    want = Counter((k, " ".join(p[i:i + k])) for _, t in rows for p in split(t) for k in (1, 2, 3)
                   for i in range(len(p) - k + 1))
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é\t.\n日 "), max_size=30), min_size=1, max_size=4))
def test_words_of_a_chunk(texts):
    w = C.Words(texts, ["en"] * len(texts))
    want = [(i, x) for i, t in enumerate(texts) for p in split(t) for x in p]
    assert [(int(i), w.phrase(j, 1)) for j, i in enumerate(w.text)] == want
    for k in (2, 3):
        h, ok = w.hashes(k)
        grams = [tuple(p[i:i + k]) for t in texts for p in split(t) for i in range(len(p) - k + 1)]
        assert [tuple(w.phrase(i, k).split(" ")) for i in np.flatnonzero(ok)] == grams
        assert len(set(h[ok].tolist())) == len(set(grams))


def _spread(spark):
    rows = [(i, "en", f"alpha beta gamma. n{i}") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)


def test_texts_are_found_in_a_share_of_the_documents(spark, monkeypatch):
    """Rows with texts follow the frequent phrases, not tasks times phrases."""
    monkeypatch.setattr(C, "_texts", None)
    got = sorted(tuple(r) for r in C.frequent_phrases(_spread(spark)).collect())
    words = ["alpha", "beta", "gamma"]
    assert got == sorted([("en", 0, "", 6000)] + [("en", b - a, " ".join(words[a:b]), 1500)
                                                  for a in range(3) for b in range(a + 1, 4)])


def test_hashes_of_several_phrases_are_counted_as_texts(spark):
    docs = _spread(spark)
    cols = [docs["lang"], docs["text"]]
    found = C._count(docs.select(*cols), range(1, 6), lambda w, k, ok: ok, 100)
    want = sorted(C._named(docs, cols, ["doc_id", "text"], found, 5, 100).collect())
    for broken in (found.withColumn("s", found.s + 1), found.unionByName(found.withColumn("s", found.s + 1))):
        assert sorted(C._named(docs, cols, ["doc_id", "text"], broken, 5, 100).collect()) == want
    assert len(want) == 7
