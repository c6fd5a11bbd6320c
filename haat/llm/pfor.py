"""Token ids in patched frame-of-reference files.

A file holds the ids of its documents one after the other, in blocks of 128.
Of a block the minimum is subtracted; the differences are packed at the bit
width that the block's 90th percentile needs, and those that need more are
stored in an exception list.  Little-endian layout:

    "PFR1"
    blocks:      u32 minimum, u16 ids, u8 width, u8 exceptions,
                 16 x width bytes of packed differences (128 slots),
                 u8 position x exceptions, u32 difference x exceptions
    block index: u64 file offset x blocks, and the offset where blocks end
    documents:   i64 doc_id, u8 has an id, i64 ids  (three columns)
    tail:        u64 offset of the index, u64 blocks, u64 documents, "PFR1"

The block index gives random access: ids a to b lie in blocks a // 128 to
(b - 1) // 128.

Writing: the documents are range-partitioned and sorted by id, and each task
encodes its range into one file in the folder that all executors share, under
a name of its own, then renames it; a task that runs twice replaces the file
by the same one.  Reading: one task per file decodes blocks through the index.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.llm.common import cut, shared_dir, ship, task
from haat.llm.tokens import TOKENS, default_tokenizer, encoder, in_chunks

BLOCK = 128
RANK = -(-BLOCK * 9 // 10) - 1       # of the 90th percentile in a sorted block
MAGIC = b"PFR1"
AT_ONCE = 4096                       # blocks that are encoded or decoded at once


def _holds(width: int) -> str:
    """The smallest integer type that holds so many bits."""
    return "<u1" if width <= 8 else "<u2" if width <= 16 else "<u4"


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (u32) as bytes, and each block's offset there."""
    n = -(-len(ids) // BLOCK)
    counts = np.full(n, BLOCK, np.uint16)
    if len(ids) % BLOCK:
        counts[-1] = len(ids) % BLOCK
        ids = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], np.uint32)])
    values = ids.reshape(n, BLOCK)
    low = values.min(1)
    diff = values - low[:, None]
    top = np.partition(diff, RANK, axis=1)[:, RANK]
    width = np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.int64)
    over = diff > ((1 << width) - 1).astype(np.uint32)[:, None]
    n_over = over.sum(1)
    size = 8 + 16 * width + 5 * n_over
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    head = np.zeros(n, np.dtype([("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("over", "u1")]))
    head["low"], head["n"], head["width"], head["over"] = low, counts, width, n_over
    out[at[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(n, 8)
    kept = np.where(over, 0, diff)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(kept[rows].astype(_holds(w)).reshape(-1).view(np.uint8), bitorder="little")
            bits = bits.reshape(len(rows) * BLOCK, -1)[:, :w]
            packed = np.packbits(bits.reshape(-1), bitorder="little").reshape(len(rows), -1)
            out[at[rows, None] + 8 + np.arange(16 * w)] = packed
    blocks, places = np.nonzero(over)
    if len(blocks):
        nth = np.arange(len(blocks)) - np.concatenate([[0], np.cumsum(n_over)])[blocks]
        start = at[blocks] + 8 + 16 * width[blocks]
        out[start + nth] = places
        big = diff[blocks, places].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(start + n_over[blocks] + 4 * nth)[:, None] + np.arange(4)] = big
    return out.tobytes(), at[:-1]


def unpack_blocks(data: bytes, at: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``at`` in ``data``."""
    raw, n = np.frombuffer(data, np.uint8), len(at)
    head = raw[at[:, None] + np.arange(8)].copy().view(
        np.dtype([("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("over", "u1")]))[:, 0]
    width, n_over = head["width"].astype(np.int64), head["over"].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            packed = raw[at[rows, None] + 8 + np.arange(16 * w)].reshape(-1)
            bits = np.zeros((len(rows) * BLOCK, 8 * np.dtype(_holds(w)).itemsize), np.uint8)
            bits[:, :w] = np.unpackbits(packed, bitorder="little").reshape(-1, w)
            diff[rows] = np.packbits(bits.reshape(-1), bitorder="little").view(_holds(w)).reshape(-1, BLOCK)
    blocks = np.repeat(np.arange(n), n_over)
    if len(blocks):
        nth = np.arange(len(blocks)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        start = at[blocks] + 8 + 16 * width[blocks]
        big = raw[(start + n_over[blocks] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        diff[blocks, raw[start + nth]] = big
    ids = diff + head["low"][:, None]
    if n and head["n"][-1] < BLOCK:
        return ids.reshape(-1)[: (n - 1) * BLOCK + int(head["n"][-1])]
    return ids.reshape(-1)


class Writer:
    def __init__(self, out):
        self.out, self.at = out, 4
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.index: list[np.ndarray] = []
        self.docs: list[tuple] = []
        out.write(MAGIC)

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is not None, len(ids)))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= AT_ONCE * BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.rest])
        whole = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, AT_ONCE * BLOCK):
            data, at = pack_blocks(ids[a:min(a + AT_ONCE * BLOCK, whole)])
            self.out.write(data)
            self.index.append(at + self.at)
            self.at += len(data)
        self.rest = [ids[whole:].copy()]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = np.concatenate([*self.index, [self.at]]).astype("<u8")
        cols = [np.array([d[i] for d in self.docs], k) for i, k in enumerate(("<i8", "u1", "<i8"))]
        for part in (index, *cols):
            self.out.write(part.tobytes())
        self.out.write(struct.pack("<QQQ", self.at, len(index) - 1, len(self.docs)) + MAGIC)


class Reader:
    def __init__(self, file):
        self.file = file
        tail = self._at(file.size() - 28, 28)
        start, n, docs = struct.unpack("<QQQ", tail[:24])
        if tail[24:] != MAGIC:
            raise ValueError("not a PFR1 file, or a part of one")
        self.index = np.frombuffer(self._at(start, 8 * (n + 1)), "<u8").astype(np.int64)
        where = start + 8 * (n + 1)
        self.ids = np.frombuffer(self._at(where, 8 * docs), "<i8")
        self.has = np.frombuffer(self._at(where + 8 * docs, docs), "u1")
        self.lengths = np.frombuffer(self._at(where + 9 * docs, 8 * docs), "<i8")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def read(self, a: int, b: int) -> np.ndarray:
        """The file's ids a to b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK + 1
        at = self.index[first:last + 1]
        ids = unpack_blocks(self._at(int(at[0]), int(at[-1] - at[0])), at[:-1] - at[0])
        return ids[a - first * BLOCK:b - first * BLOCK]

    def documents(self):
        """(doc_id, start, n_tokens, crc32 of the ids), in file order."""
        step, have, base = AT_ONCE * BLOCK, np.zeros(0, np.uint32), 0
        total = int(self.lengths.sum())
        for doc, has, start, n in zip(self.ids.tolist(), self.has.tolist(), self.starts.tolist(),
                                      self.lengths.tolist()):
            crc, at = 0, start
            while at < start + n:
                if at >= base + len(have):
                    base, have = at // BLOCK * BLOCK, self.read(at // BLOCK * BLOCK, min(total, at // BLOCK * BLOCK + step))
                to = min(start + n, base + len(have))
                crc = zlib.crc32(have[at - base:to - base].astype("<u4").tobytes(), crc)
                at = to
            yield (doc if has else None), start, n, crc


def filesystem(uri: str):
    """(file system, path) of a folder; executors open it themselves."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
          tokenizer: str | None = None) -> DataFrame:
    """Encode every text, append id 0, and write the files; returns one row per
    file: part, path, n_docs, n_tokens.  Parts follow each other in id order
    (null ids first; equal ids by text hash).  Null text counts as empty.
    Other columns are not read; an empty table makes no files."""
    tokenizer = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        part, own = task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}"
        files, path = filesystem(folder)
        enc = encoder(tokenizer)
        out = writer = None
        for batch in batches:
            for ids, texts in in_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/.{own}.tmp")
                    writer = Writer(out)
                found, at = enc.encode(texts, end=0)
                at = at.tolist()
                for doc, a, z in zip(ids, at, at[1:]):
                    writer.add(doc, found[a:z])
        if writer is not None:
            writer.close()
            out.close()
            files.move(f"{path}/.{own}.tmp", f"{path}/part-{part:06d}.pfor")
            yield pa.RecordBatch.from_pylist([{
                "part": part, "path": f"part-{part:06d}.pfor", "n_docs": len(writer.docs),
                "n_tokens": sum(d[2] for d in writer.docs)}])

    return cut(ranged.mapInArrow(task(run, TOKENS), "part long, path string, n_docs long, n_tokens long"))


def read(files_written: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    read back from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    parts = files_written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))) \
        .select("path", "base")
    n = max(1, min(files_written.count(), 10_000))

    def run(batches):
        files, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{path}/{row['path']}") as f:
                    rows = []
                    for doc, start, n_tokens, crc in Reader(f).documents():
                        rows.append((doc, row["base"] + start, n_tokens, crc))
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return parts.repartition(n).mapInArrow(task(run, TOKENS), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pfor-{uuid.uuid4().hex[:12]}"
