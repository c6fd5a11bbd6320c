import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from haat.llm.best_fit import OpenBins, best_fit, default_tokenizer
from haat.llm.tokens import default_tokenizer as byte_tokenizer
from haat.llm.units import Encoder
from tests.llm import helpers

ENCODERS = {}


def encoder(path):
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def whole(texts, path):
    """The library on whole texts, nothing cut."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ours(texts, path, end=None):
    ids, at = encoder(path).encode([x or "" for x in texts], end)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


PATHS = [default_tokenizer(), byte_tokenizer()]


@pytest.mark.parametrize("path", PATHS)
def test_units_give_the_ids_of_whole_texts(spark, path):
    texts = [r.text for r in helpers.read(spark, sf="/root/testdata/sf0.01").select("text").collect()]
    texts += helpers.ODD_TEXTS
    want = whole(texts, path)
    assert ours(texts, path) == want
    assert ours(texts, path) == want                                    # from the table
    assert ours(texts, path, 0) == [x + [0] for x in want]
    assert ours([], path) == [] and ours(["", None], path, 7) == [[7], [7]]


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(
    st.sampled_from(" \n\t'sé.,ßa1 ᠎ İ×÷̈A日я\r\x0b\x1c"), st.characters(codec="utf-8"))), max_size=5))
def test_units_on_any_text(path, texts):
    assert ours(texts, path) == whole(texts, path)


class PlainBins:
    """Best fit by looking at every open bin."""

    def __init__(self, size, limit):
        self.size, self.limit, self.room, self.opened = size, limit, {}, 0

    def place(self, n):
        fits = [r for r in self.room.values() if r >= n]
        if fits:
            room = min(fits)
        else:
            if len(self.room) == self.limit and n < self.size:
                fullest = min(self.room.values())
                # Of equally full bins the one that came to that room last.
                del self.room[[b for b, r in self.room.items() if r == fullest][-1]]
            room, self.opened = self.size, self.opened + 1
            self.room[self.opened - 1] = self.size
        number = [b for b, r in self.room.items() if r == room][-1]
        del self.room[number]
        if room > n:
            self.room[number] = room - n
        return number, self.size - room


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.data())
def test_bins_against_plain_search(size, limit, data):
    bins, plain = OpenBins(size, limit), PlainBins(size, limit)
    for n in data.draw(st.lists(st.integers(1, size), max_size=60)):
        assert bins.place(n) == plain.place(n)
        assert bins.open == len(plain.room) <= limit


def check(rows, ids, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, ps in by_doc.items():
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert [p.length for p in ps[:-1]] == [size] * (len(ps) - 1)
        assert sum(p.length for p in ps) == len(ids[doc])
        for p in ps:
            part = ids[doc][p.start:p.start + p.length]
            assert p.start == p.piece * size and p.ids == part
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for ps in by_seq.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert sum(p.length for p in ps) <= size
    return len(by_seq)


def test_whole_table(spark):
    docs = helpers.read(spark, sf="/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: x + [0] for i, x in zip(texts, whole(list(texts.values()), default_tokenizer()))}
    n = check(best_fit(docs.coalesce(1)).collect(), ids, 2048)
    least = -(-sum(map(len, ids.values())) // 2048)
    print("sequences", n, "at least", least)
    assert n <= 1.03 * least


@pytest.mark.parametrize("size, bins", [(2048, 2048), (16, 1), (7, 2), (1, 1)])
def test_odd_rows(spark, size, bins):
    docs = helpers.documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {i: x + [0] for i, x in zip(texts, whole(list(texts.values()), default_tokenizer()))}
    check(best_fit(docs, max_tokens=size, open_bins=bins).collect(), ids, size)


def test_nulls_repeats_and_none(spark):
    docs = helpers.with_null_and_repeats(spark)
    rows = best_fit(docs, with_ids=False).collect()
    assert len(rows) == len(best_fit(docs).collect()) and any(r.doc_id is None for r in rows)
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in whole(
        [r.text for r in docs.collect()], default_tokenizer()))
    assert best_fit(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        best_fit(docs, max_tokens=0)
