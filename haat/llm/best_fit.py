"""Best-fit packing with a bounded number of open bins.

A task places its pieces as they come.  Its open bins are kept in a bitset
keyed by free space: bit f is set while some open bin has f tokens of room.
A piece of n tokens goes where the least room that is enough remains, which is
the lowest set bit from n on.  Where no open bin has room a new one opens; when
all places are taken the fullest bin, at the lowest set bit of all, closes
first.  A bin is only its number and its room, so pieces leave the task as soon
as they are placed, and memory does not grow with the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.llm.common import ship, task
from haat.llm.tokens import TOKENS, encoder, in_chunks


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class OpenBins:
    """At most ``limit`` open bins of ``size`` tokens."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits = 0
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.opened = 0

    def _take(self, room: int) -> int:
        bins = self.by_room[room]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << room
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of ``n`` tokens, 1 to ``size``."""
        enough = self.bits >> n
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.limit and n < self.size:
                self._take((self.bits & -self.bits).bit_length() - 1)
            room, number = self.size, self.opened
            self.opened += 1
        if room > n:
            self.by_room[room - n].append(number)
            self.bits |= 1 << room - n
            self.open += 1
        return number, self.size - room


SCHEMA = ("doc_id long, piece int, start long, length long, ids array<long>, ids_crc32 long, sequence_id long, "
          "offset long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048,
             open_bins: int = 2048, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids,
    ids_crc32, sequence_id, offset.

    A document is its ids and the end id 0.  Only one with more than
    ``max_tokens`` is cut, into pieces of ``max_tokens`` and a shorter last
    one.  Sequence ids are unique, not gapless.  Each task packs what it reads
    and leaves at most ``open_bins`` sequences with room behind.

    * null text counts as empty: such a document is its end id;
    * rows that repeat an id are packed each; a null id is carried through;
    * other columns are not read; an empty table gives an empty result.
    """
    tokenizer = tokenizer or default_tokenizer()
    if min(max_tokens, open_bins) < 1:
        raise ValueError("limits must be positive")
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext
        units, bins = encoder(tokenizer), OpenBins(max_tokens, open_bins)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            for docs_of, texts in in_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, at = units.encode(texts, end=0)
                yield _pieces(docs_of, ids, at, bins, base)

    def _pieces(docs_of, ids, at, bins, base):
        at = at.astype(np.int64)
        n = np.diff(at)
        per_doc = -(-n // max_tokens)
        doc = np.repeat(np.arange(len(n)), per_doc)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        start = piece * max_tokens
        length = np.minimum(max_tokens, n[doc] - start)
        first = at[doc] + start
        spans = list(zip(first.tolist(), (first + length).tolist()))
        placed = np.array([bins.place(x) for x in length.tolist()], np.int64).reshape(-1, 2)
        crc = np.array([zlib.crc32(ids[a:z]) for a, z in spans], np.int64)
        if with_ids:
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            whole = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64)))
        else:
            whole = pa.nulls(len(doc), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([docs_of[i] for i in doc.tolist()], pa.int64()), pa.array(piece.astype(np.int32)),
             pa.array(start), pa.array(length), whole, pa.array(crc), pa.array(base + placed[:, 0]),
             pa.array(placed[:, 1])], NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task(run, TOKENS), SCHEMA)
