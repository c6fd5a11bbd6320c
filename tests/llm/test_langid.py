"""Language ID: held-out accuracy, the model against its definition, edges."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haat.llm.langid import accepted, grams, identify, train
from tests.llm import helpers


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def clean(text):
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    body = " ".join(out.split())
    return body + (" " if out[-1:] == " " and body else "")


def test_grams_are_the_last_four_letters():
    texts = ["Ab, c", "", "x", "!?a"]
    keys, of = grams(texts)
    spelled = defaultdict(list)
    for k, d in zip(keys.tolist(), of.tolist()):
        spelled[d].append("".join(chr(k >> s & 0xFFFF) for s in (48, 32, 16, 0)))
    assert spelled[0] == ["   a", "  ab", " ab ", "ab c"]
    assert spelled[2] == ["   x"] and spelled[3] == ["   a"] and 1 not in spelled


def slow_kn(texts):
    """Interpolated Kneser-Ney of one language, straight from the definition."""
    four = Counter()
    for t in texts:
        s = "   " + clean(t)
        four.update(s[i - 3:i + 1] for i in range(3, len(s)))
    level = {4: four}
    for n in (3, 2, 1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    d = {}
    for n, c in level.items():
        ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d[n] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def prob(g, n=4):
        if n == 0:
            return 1 / (len(level[1]) + 1)
        g = g[-n:]
        ctx = [c for x, c in level[n].items() if x[:-1] == g[:-1]]
        if not ctx:
            return prob(g, n - 1)
        return max(level[n][g] - d[n], 0) / sum(ctx) + d[n] * len(ctx) / sum(ctx) * prob(g, n - 1)
    return prob


def test_model_is_kneser_ney(spark):
    texts = ["the cat sat on the mat", "the dog and the cat", "a hat and a bat that sat"]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    model, prob = train(df), slow_kn(texts)
    for probe in texts + ["zebra the", "q"]:
        keys, _ = grams([probe])
        s = "   " + clean(probe)
        want = [prob(s[i - 3:i + 1]) for i in range(3, len(s))]
        assert np.allclose(model.prob(4, keys)[:, 0], want, rtol=1e-4)


def test_held_out_accuracy(spark):
    docs = helpers.read(spark, sf="/root/testdata/sf0.01")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) for r in got)
    right = sum(r.lang_pred == truth[r.doc_id][0] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_rejects_what_no_language_explains(spark):
    docs = helpers.read(spark, sf="/root/testdata/sf0.01").select("doc_id", "text", "lang")
    noise = ["".join(chr(0x4E00 + (i * j * 7919) % 5000) for i in range(1, 300)) for j in range(1, 9)] \
        + ["12345 67890 !!!", "", None, "Б" * 200]
    more = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(noise)], docs.schema)
    got = identify(docs.union(more)).filter("doc_id >= 10000000").collect()
    assert len(got) == len(noise) and all(r.rejected for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in noise[r.doc_id - 10_000_000] or "")) for r in got)
    kept = accepted(docs.union(more))
    assert kept.filter("doc_id >= 10000000").count() == 0 and kept.columns == docs.columns
    assert kept.count() >= 0.99 * docs.count()


def test_edges(spark):
    assert identify(helpers.empty(spark)).count() == 0
    unlabelled = helpers.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score, r.rejected) for r in identify(unlabelled).collect()} == {("und", 0.0, True)}
    docs = helpers.with_null_and_repeats(spark)
    got = identify(docs).collect()
    assert len(got) == docs.count()
    assert all(r.held_out for r in got if r.doc_id is None)
    blank = {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert all((r.lang_pred == "und") == (r.doc_id in blank) for r in got)


@pytest.mark.parametrize("held", [300, 1])
def test_a_model_larger_than_tasks_hold_changes_nothing(spark, held):
    docs = helpers.read(spark).select("doc_id", "text", "lang")
    more = [(10_000_000 + i, t, None) for i, t in enumerate(helpers.ODD_TEXTS)] \
        + [(20_000_001 + 4 * i, "語言日本" * 3 + "ab" * i + "\U00010400" * i, "xx") for i in range(8)] + [(None, "und so", "de")]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    got, want = (sorted(identify(docs, max_ngrams=n).collect(), key=lambda r: (r.doc_id or 0, r.text_hash))
                 for n in (held, 1_000_000))
    assert len(got) == len(want) == docs.count()
    for g, w in zip(got, want):
        assert (g.doc_id, g.text_hash, g.held_out, g.n_units) == (w.doc_id, w.text_hash, w.held_out, w.n_units)
        if w.score < 0.99 and w.cross_entropy is not None:      # ties by rounding
            assert abs(g.score - w.score) < 1e-3
        else:
            assert (g.lang_pred, g.rejected) == (w.lang_pred, w.rejected)
        assert g.cross_entropy == w.cross_entropy or abs(g.cross_entropy - w.cross_entropy) < 1e-4


def test_limit_of_the_length_class(spark):
    """Long texts that are part noise: within the limit that short texts make,
    over the one of long texts.  A class with few texts takes the one of all."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(200)]

    def text(n, noise=0.0):
        return " ".join("".join(rng.choice(list("abcdefgh"), 6)) if rng.random() < noise else str(w)
                        for w in rng.choice(words, n))
    rows = [(i, text(250) if i % 2 else text(int(rng.integers(1, 4)), 0.1), "xx") for i in range(4000)]
    noisy = [(5000 + i, text(250, 0.5), None) for i in range(5)]
    df = spark.createDataFrame(rows + noisy, "doc_id long, text string, lang string")
    for enough, rejected in ((1000, 5), (10 ** 6, 0)):
        got = identify(df, enough=enough).collect()
        assert sum(r.rejected for r in got if r.doc_id >= 5000) == rejected
        assert sum(r.rejected for r in got if r.doc_id < 5000) <= 40
