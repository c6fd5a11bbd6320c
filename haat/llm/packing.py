"""Vector bin packing of token sequences.

Every sequence is held to three limits at once: tokens, segments (pieces of
documents) and loss-bearing tokens.  A document, its ids and the end id 0, may
be cut anywhere.  Pieces that fill a sequence alone are cut off first; the
rest waits in a pool.  Into an open sequence goes, again and again, the piece
that fits and has the largest dot product of its demand with what is left of
the limits, each dimension weighted by how scarce it is in the pool.  When
none fits whole, the longest is cut to fill what is left.

Each task packs what it reads, in one pass: no shuffle, and a pool of bounded
size.  What closes below the token limit, because it has reached another limit
or nothing remains at a task's end, is cut into sequences whose lengths are
powers of two, so that it needs no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haat.llm.common import columns, ship, task
from haat.llm.tokens import TOKENS, default_tokenizer, encoder, in_chunks

POOL = 2048      # pieces that wait at most, of less than one sequence each


@dataclass
class Item:
    """What is left of a document: ids[start:], loss from ``loss`` on."""
    doc: object
    ids: np.ndarray
    start: int
    loss: int

    @property
    def length(self) -> int:
        return len(self.ids) - self.start

    def loss_of(self, n: int) -> int:
        return max(0, self.start + n - max(self.loss, self.start))

    def most(self, tokens: int, loss: int) -> int:
        """The longest beginning within the limits."""
        return min(self.length, tokens, max(self.loss - self.start, 0) + loss)


class Packer:
    """Pieces (doc, start, length, ids, doc_tokens, loss start, sequence,
    offset) of the documents that ``add`` takes."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.cap = np.array([tokens, segments, loss], dtype=np.float64)
        self.pool: list[Item] = []
        self.demand = np.zeros((POOL, 3))
        self.n = 0
        self.sequence = 0

    def add(self, item: Item) -> Iterator[tuple]:
        tokens, _, loss = (int(x) for x in self.cap)
        while item.length >= tokens or item.loss_of(item.length) > loss:
            n = item.most(tokens, loss)
            yield from self._out([self._take(item, n)])
        if item.length:
            self._put(item)
        if self.n == POOL:
            while self.n > POOL // 2:
                yield from self._out(self._fill())

    def finish(self) -> Iterator[tuple]:
        while self.n:
            yield from self._out(self._fill())

    def _out(self, pieces: list[tuple]) -> Iterator[tuple]:
        full = sum(p[2] for p in pieces) == self.cap[0]
        yield from self._close(pieces) if full else self._powers(pieces)

    def _put(self, item: Item) -> None:
        self.demand[self.n] = item.length, 1, item.loss_of(item.length)
        self.pool.append(item)
        self.n += 1

    def _drop(self, i: int) -> Item:
        item, last = self.pool[i], self.pool.pop()
        self.n -= 1
        if i < self.n:
            self.pool[i] = last
            self.demand[i] = self.demand[self.n]
        return item

    @staticmethod
    def _take(item: Item, n: int) -> tuple:
        piece = (item.doc, item.start, n, item.ids[item.start:item.start + n], len(item.ids), item.loss)
        item.start += n
        return piece

    def _fill(self) -> list[tuple]:
        left, pieces = self.cap.copy(), []
        scarce = self.demand[:self.n].sum(0) / self.cap
        scarce /= max(scarce.sum(), 1e-9)
        while self.n and left[0] and left[1]:
            demand = self.demand[:self.n]
            fits = (demand <= left).all(1)
            if fits.any():
                worth = np.where(fits, demand @ (scarce * left / self.cap ** 2), -1.0)
                item = self._drop(int(worth.argmax()))
                n = item.length
            else:
                i = int(demand[:, 0].argmax())
                n = self.pool[i].most(int(left[0]), int(left[2]))
                if not n:
                    break
                item = self._drop(i)
            left -= (n, 1, item.loss_of(n))
            pieces.append(self._take(item, n))
            if item.length:
                self._put(item)
        return pieces

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield *p, self.sequence, at
            at += p[2]
        self.sequence += 1

    def _powers(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The pieces, cut again, in sequences of falling powers of two."""
        total = sum(p[2] for p in pieces)
        for bit in range(total.bit_length() - 1, -1, -1):
            room, out = total & 1 << bit, []
            while room:
                doc, start, n, ids, whole, loss = pieces.pop(0)
                if n > room:
                    pieces.insert(0, (doc, start + room, n - room, ids[room:], whole, loss))
                    n, ids = room, ids[:room]
                out.append((doc, start, n, ids, whole, loss))
                room -= n
            if out:
                yield from self._close(out)


SCHEMA = ("doc_id long, start long, length long, ids array<long>, ids_crc32 long, doc_tokens long, "
          "loss_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
         max_tokens: int = 1024, max_segments: int = 128, max_loss: int | None = None,
         tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens,
    loss_tokens, sequence_id, offset.

    For instruction data ``prompt_col`` names a text that comes before the
    document's and bears no loss; without it every token does.  ``max_loss``
    is ``max_tokens`` by default.  Sequence ids are unique, not gapless.

    * null text (or prompt) counts as empty: such a document is its end id;
    * documents of any length are cut; rows that repeat an id are packed each;
    * a null id is carried through; other columns are not read;
    * an empty table gives an empty result.
    """
    tokenizer = tokenizer or default_tokenizer()
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    ship(docs.sparkSession)
    cols = [c for c in (id_col, text_col, prompt_col) if c]

    def run(batches):
        from pyspark import TaskContext
        enc, packer = encoder(tokenizer), Packer(max_tokens, max_segments, max_loss)
        base = TaskContext.get().partitionId() << 32

        def items():
            for batch in batches:
                ids = list(zip(batch.column(0).to_pylist(),
                               batch.column(2).to_pylist() if prompt_col else [""] * len(batch)))
                for some, texts in in_chunks(ids, batch.column(1).to_pylist()):
                    ids, at = enc.encode(texts, end=0)
                    at = at.tolist()
                    if not prompt_col:
                        for (doc, _), a, z in zip(some, at, at[1:]):
                            yield Item(doc, ids[a:z].copy(), 0, 0)
                        continue
                    heads, h_at = enc.encode([p or "" for _, p in some])
                    h_at = h_at.tolist()
                    for (doc, _), a, z, b, y in zip(some, at, at[1:], h_at, h_at[1:]):
                        yield Item(doc, np.concatenate([heads[b:y], ids[a:z]]), 0, y - b)

        def pieces():
            for item in items():
                yield from packer.add(item)
            yield from packer.finish()

        rows = []
        for doc, start, n, ids, whole, loss, seq, at in pieces():
            rows.append((doc, start, n, ids.tolist() if with_ids else None, zlib.crc32(ids), whole,
                         max(0, start + n - max(loss, start)), base + seq, at))
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return docs.select(*columns(docs.select(*cols))).mapInArrow(task(run, TOKENS), SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.list_(pa.int64()) if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
