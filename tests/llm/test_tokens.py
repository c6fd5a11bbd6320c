import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from haat.llm import pfor
from haat.llm.packing import pack
from haat.llm.tokens import default_tokenizer, encoder
from tests.llm import helpers


def whole(texts):
    """The library on whole texts, nothing cut."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts):
    ids, at = encoder(default_tokenizer()).encode([x or "" for x in texts])
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_pieces_give_the_ids_of_whole_texts(spark):
    texts = [r.text for r in helpers.read(spark, sf="/root/testdata/sf0.01").select("text").collect()]
    texts += helpers.ODD_TEXTS
    assert ours(texts) == whole(texts)
    assert ours(texts) == whole(texts)      # from the tables


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sé.,ßa1 ᠎ "), st.characters(codec="utf-8"))),
                max_size=5))
def test_pieces_on_any_text(texts):
    assert ours(texts) == whole(texts)


def check_packing(rows, texts, max_tokens=1024, max_segments=128, max_loss=1024, padded=True):
    ids = {i: x + [0] for i, x in zip(texts, whole(list(texts.values())))}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, ps in by_doc.items():
        ps.sort(key=lambda r: r.start)
        assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert sum(p.length for p in ps) == len(ids[doc]) == ps[0].doc_tokens
        for p in ps:
            part = ids[doc][p.start:p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and p.ids == part
    for ps in by_seq.values():
        ps.sort(key=lambda r: r.offset)
        n = sum(p.length for p in ps)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert n <= max_tokens and len(ps) <= max_segments and sum(p.loss_tokens for p in ps) <= max_loss
        if padded:
            assert n == max_tokens or n & (n - 1) == 0


def test_packing_of_a_table(spark):
    docs = helpers.read(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(pack(docs).collect(), texts)


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 64, 20), (16, 1, 16), (1, 1, 1)])
def test_packing_limits(spark, limits):
    docs = helpers.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack(docs.coalesce(1), max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2]).collect()
    check_packing(rows, texts, *limits, padded=False)


def test_packing_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(1, "q " * 50, "answer one"), (2, None, "b"), (3, "only prompt", None)],
                               "doc_id long, prompt string, text string")
    rows = pack(df, prompt_col="prompt", max_tokens=32, max_loss=3).collect()
    answers = dict(zip((1, 2, 3), whole(["answer one", "b", ""])))
    for doc, a in answers.items():
        assert sum(r.loss_tokens for r in rows if r.doc_id == doc) == len(a) + 1
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in s) <= 32 and sum(r.loss_tokens for r in s) <= 3 for s in seqs.values())


def test_packing_edges(spark):
    assert pack(helpers.empty(spark)).count() == 0
    rows = pack(helpers.with_null_and_repeats(spark)).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2        # null text, twice: its end id
    assert any(r.doc_id is None for r in rows)
    with pytest.raises(ValueError):
        pack(helpers.documents(spark), max_tokens=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=700))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    data, at = pfor.pack_blocks(ids)
    assert pfor.unpack_blocks(data, at).tolist() == ids.tolist()


def test_outliers_become_exceptions():
    ids = np.full(128, 7, np.uint32)
    ids[5] = 4_000_000_000
    data, _ = pfor.pack_blocks(ids)
    assert len(data) == 8 + 0 + 5        # header, width 0, one exception


def by_hand(rows):
    at, out = 0, []
    for (doc, _), ids in zip(rows, whole([t for _, t in rows])):
        ids = ids + [0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_files_round_trip(spark, sf):
    docs = helpers.read(spark, sf=f"/root/testdata/sf{sf}")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    folder = pfor.new_folder(spark)
    got = pfor.read(pfor.write(docs, folder), folder).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows)


def test_files_edges(spark):
    folder = pfor.new_folder(spark)
    assert pfor.read(pfor.write(helpers.empty(spark), folder), folder).count() == 0
    docs = helpers.with_null_and_repeats(spark)
    folder = pfor.new_folder(spark)
    got = sorted((tuple(r) for r in pfor.read(pfor.write(docs, folder), folder).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == by_hand(rows)


def test_random_access(spark):
    docs = helpers.read(spark).coalesce(1)
    folder = pfor.new_folder(spark)
    files = pfor.write(docs, folder).orderBy("part").collect()
    fs, path = pfor.filesystem(folder)
    ids = [i for _, t in sorted((r.doc_id, r.text) for r in docs.collect()) for i in whole([t])[0] + [0]]
    with fs.open_input_file(f"{path}/{files[0].path}") as f:
        reader = pfor.Reader(f)
        for a, b in ((0, 1), (127, 129), (100, 1000), (500, 500)):
            assert reader.read(a, b).tolist() == ids[a:b]


def test_sequences_of_many_tiny_texts_need_no_padding(spark):
    texts = {i: "ab"[:i % 3] for i in range(5000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check_packing(pack(df).collect(), texts)
    check_packing(pack(df, max_tokens=64, max_segments=64, max_loss=20).collect(), texts, 64, 64, 20)
