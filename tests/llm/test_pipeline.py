"""The pipeline's stages and their hand-over against plain Python."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haat.llm.common import shared_dir
from haat.llm.mixing import mix
from tests.llm import helpers
from tests.llm.test_near import slow_components, slow_fingerprint, whole_blocks
from tests.llm.test_tokens import check_packing


@pytest.fixture
def many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_sequences_follow_the_schedule(spark, many_partitions):
    rows = [(i, f"text of {i}", "abbcccc"[i % 7]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = {r.doc_id: (r.mix_position, r.mix_place) for r in mix(docs).collect()}
    shuffled = docs.orderBy(F.xxhash64("doc_id")).repartition(5)
    runs = {}
    for r in corpus_pipeline.packing(spark, shuffled, "").collect():
        runs.setdefault(r.sequence_id >> 32, set()).add(place[r.doc_id])
    runs = [runs[k] for k in sorted(runs)]
    assert len(runs) > 1 and all(max(a) < min(b) for a, b in zip(runs, runs[1:]))


def test_run_on_a_planted_table(spark, tmp_path):
    base = [r for r in helpers.read(spark).select("doc_id", "text", "lang", "source").orderBy("doc_id").limit(60).collect()]
    body = [x for r in base for x in r.text.split("\n") if len(x.split()) > 60][:1][0].split()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in base]
    noise = ["".join(chr(0x4E00 + (i * j * 7919) % 5000) for i in range(1, 300)) for j in range(1, 5)] + ["1 2 !", "", None]
    rejected = {90_000_000 + i for i in range(len(noise))}
    rows += [(90_000_000 + i, t, None, "noise") for i, t in enumerate(noise)]
    rows += [(80_000_000, base[0].text, base[0].lang, "copies"),
             (80_000_001, "own start\n" + base[1].text + "\nown end", base[1].lang, "copies")]
    rows += [(70_000_000 + i, " ".join(body + ["end"] * (i > 0)) + " " * i, base[0].lang, None) for i in range(2)]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string") \
        .write.parquet(str(folder / "documents.parquet"))
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pipeline-*"))
    final = corpus_pipeline.run(spark, str(folder))
    (made,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pipeline-*")) - before
    assert sorted(os.listdir(made)) == [f"{i}-{n}" for i, (n, _) in enumerate(corpus_pipeline.STAGES)]
    out = [{r.doc_id: (r.text, r.lang, r.source) for r in spark.read.parquet(f"{made}/{i}-{n}").collect()}
           for i, (n, _) in enumerate(corpus_pipeline.STAGES[:-1])]

    assert out[0] == {i: (t, *x) for i, t, *x in rows if i not in rejected}
    texts = {i: x[0] for i, x in out[0].items()}
    gone = whole_blocks(texts.items())
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in texts.items()}
    left = {i: t for i, t in left.items() if t.strip() or not gone[i]}
    assert out[1] == {i: (t, *out[0][i][1:]) for i, t in left.items()}
    assert 80_000_000 not in left and left[80_000_001] == "own start\nown end"
    fps = [(i, slow_fingerprint(t)) for i, t in left.items()]
    least = slow_components(fps)
    assert out[2] == {i: out[1][i] for i, f in fps if least[f] == i}
    assert out[3] == out[2]
    pieces = final.collect()
    check_packing(pieces, {i: x[0] for i, x in out[3].items()})
    assert np.unique([r.sequence_id for r in pieces]).size > 1


def test_input_columns_survive_clashing_names(spark):
    """Columns called like outputs, or like names used on the way, keep their values."""
    names = ["deleted", "earlier", "n_lines", "dedup_text", "mix_slot", "mix_position", "_id", "_hash", "stays", "input",
             "bad_id", "rank", "src", "none", "component_id"]
    plain = helpers.read(spark).select("doc_id", "text", "lang", "source").limit(80)
    odd = plain.select("*", *[(F.col("doc_id") * 100 + i).alias(n) for i, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, "")
        assert got.columns == odd.columns
        rows = got.collect()
        assert rows and all(r[n] == r.doc_id * 100 + i for r in rows for i, n in enumerate(names))
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(
            (r.doc_id, r.text) for r in stage(spark, plain, "").collect())
    assert corpus_pipeline.packing(spark, odd, "").count() == corpus_pipeline.packing(spark, plain, "").count()
