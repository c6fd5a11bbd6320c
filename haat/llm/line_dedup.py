"""Line dedup by pairwise alignment.

Of two documents the one with the larger id is the later.  Every line that
documents share has a home, the earliest document that holds it.

1. Lines that at most ``rare`` documents hold find overlapping pairs: each
   later document is paired with the line's home.  A pair's shared lines, the
   common ones among them, are aligned by patience diff: lines unique on both
   sides, longest increasing chain, then the same between its links; where no
   line is unique, the rarest one is matched.
2. Lines that more documents hold are too frequent to pair whole documents.
   Their occurrences are grouped by (later document, home), and those groups
   are aligned in the same way.  So no shared line is left out, and the rows
   stay in proportion to the line occurrences, however many documents share a
   line.
3. A short line of a block may have another home than the lines beside it.  So
   windows, the shortest runs of two or more shared lines that begin or end at
   a line and have ``min_words`` words, have homes too: up to ``rare``
   documents they pair documents as in 1, above that their lines join the
   groups of 2.  Every line of a block is such a line of ``min_words`` words
   or stands in such a window of the block.

A block is a run of aligned lines without a gap on either side (blank lines
aside).  Blocks of ``min_words`` words or more are deleted from the later
document; the alignment is repeated on what is left, so moved blocks go too.
The earliest occurrence of a line always stays.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.llm.common import columns, cut, ship, task

OUTPUTS = ("n_lines", "deleted", "earlier", "dedup_text")


# --- alignment ---------------------------------------------------------------------

def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest increasing chain of pairs (i, j) given by rising i."""
    tops: list[int] = []            # tops[k]: pair that ends the best chain of k + 1
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        lo, hi = 0, len(tops)
        while lo < hi:
            mid = (lo + hi) // 2
            if pairs[tops[mid]][1] < j:
                lo = mid + 1
            else:
                hi = mid
        back[n] = tops[lo - 1] if lo else -1
        tops[lo:lo + 1] = [n]
    out, n = [], tops[-1] if tops else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j), rising in both, of equal elements."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        both = [x for x in in_a if x in in_b]
        if not both:
            continue
        place = {b[j]: j for j in range(b1 - 1, b0 - 1, -1)}
        links = chain([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and in_b[a[i]] == 1])
        if not links:
            x = min(both, key=lambda x: in_a[x] * in_b[x])
            links = [(a.index(x, a0, a1), place[x])]
        out += links
        i, j = a0, b0
        for x, y in links:
            work.append((i, x, j, y))
            i, j = x + 1, y + 1
        work.append((i, a1, j, b1))
    return sorted(out)


def common_blocks(later: list[tuple], earlier: list[tuple], min_words: int) -> list[int]:
    """Positions to delete from the later document.  Lines are (place among
    the lines that are not blank, line key, words, position in the text)."""
    gone: list[int] = []
    earlier = sorted(earlier)
    b = [x[1] for x in earlier]
    later = sorted(later)
    while later:
        runs: list[list[int]] = []
        last = None
        for i, j in patience([x[1] for x in later], b):
            at = (later[i][0], earlier[j][0])
            if last is not None and at == (last[0] + 1, last[1] + 1):
                runs[-1].append(i)
            else:
                runs.append([i])
            last = at
        drop = {i for r in runs if sum(later[i][2] for i in r) >= min_words for i in r}
        if not drop:
            break
        gone += [later[i][3] for i in drop]
        later = [x for i, x in enumerate(later) if i not in drop]
    return sorted(gone)


# --- the operator ------------------------------------------------------------------

def lines(docs: DataFrame) -> DataFrame:
    """(d, seq, pos, line, words, first) for rows (doc_id, text): every line
    that is not blank, by a 128-bit hash of the line without outer blanks;
    ``first`` is 1 once per document and line."""
    def run(batches):
        from xxhash import xxh64_intdigest, xxh128_digest
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
                h -= (h >> 63) << 64
                seen, seq = set(), 0
                for pos, line in enumerate(text.split("\n")):
                    n = len(line.split())
                    if n:
                        key = xxh128_digest(line.strip().encode("utf-8", "surrogatepass"))
                        for col, x in zip(rows, (doc, h, seq, pos, key, n, int(key not in seen))):
                            col.append(x)
                        seen.add(key)
                        seq += 1
                if len(rows[0]) > 50_000:
                    yield _batch(rows)
                    rows = [[] for _ in rows]
            yield _batch(rows)

    out = docs.mapInArrow(task(run), "doc_id long, text_hash long, seq int, pos int, line binary, words int, first int")
    return out.select(F.struct("doc_id", "text_hash").alias("d"), "seq", "pos", "line", "words", "first")


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)],
                                      ["doc_id", "text_hash", "seq", "pos", "line", "words", "first"])


ENTRY = "array<struct<seq: int, line: binary, words: int, pos: int>>"


def spans(entries: list[tuple], min_words: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of two or more lines without a gap
    that begin or end at a line and have ``min_words`` words or more."""
    out = set()
    for step in (1, -1):
        for i in range(len(entries)):
            j, words = i, entries[i][2]
            while words < min_words and 0 <= j + step < len(entries) and \
                    entries[j + step][0] == entries[j][0] + step:
                j += step
                words += entries[j][2]
            if words >= min_words and j != i:
                out.add((min(i, j), max(i, j)))
    return out


def windows(listed: DataFrame, min_words: int) -> DataFrame:
    """(d, line, lines) for rows (d, lines) of shared lines: each window of a
    document once, by a hash of its lines, with the lines of all its places."""
    entry = pa.struct([("seq", pa.int32()), ("line", pa.binary()), ("words", pa.int32()), ("pos", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(entry)]

    def run(batches):
        from xxhash import xxh128_digest
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                entries = sorted({tuple(x.values()) for x in row["lines"]})
                found: dict[bytes, set] = {}
                for i, j in spans(entries, min_words):
                    some = entries[i:j + 1]
                    found.setdefault(xxh128_digest(b"".join(x[1] for x in some)), set()).update(some)
                for key, some in found.items():
                    whole = [dict(zip(("seq", "line", "words", "pos"), x)) for x in sorted(some)]
                    for col, x in zip(rows, (row["d"]["doc_id"], row["d"]["text_hash"], key, whole)):
                        col.append(x)
                if len(rows[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)
                    rows = [[] for _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)

    names = ["doc_id", "text_hash", "line", "lines"]
    out = listed.select("d", "lines").mapInArrow(
        task(run), f"doc_id long, text_hash long, line binary, lines {ENTRY}")
    return out.select(F.struct("doc_id", "text_hash").alias("d"), "line", "lines")


def align(pairs: DataFrame, min_words: int) -> DataFrame:
    """(d, home, deleted) for rows (d, home, later, earlier) of line lists."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                as_lists = [list({tuple(x.values()) for x in row[side]}) for side in ("later", "earlier")]
                gone = common_blocks(*as_lists, min_words)
                if gone:
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": row["d"]["doc_id"], "text_hash": row["d"]["text_hash"],
                          "home": row["home"]["doc_id"], "deleted": gone}],
                        schema=pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("home", pa.int64()),
                                          ("deleted", pa.list_(pa.int32()))]))

    return pairs.select("d", "home", "later", "earlier").mapInArrow(
        task(run), "doc_id long, text_hash long, home long, deleted array<int>")


def deletions(docs: DataFrame, min_words: int, rare: int) -> DataFrame:
    """(doc_id, text_hash, deleted, earlier) for rows (doc_id, text)."""
    every = lines(docs)
    shared = every.groupBy("line").agg(F.sum("first").alias("n_docs"), F.min("d").alias("home")) \
        .filter("n_docs > 1")
    shared = cut(every.drop("first").join(shared, "line"))
    away = F.col("home") < F.col("d")
    entry = F.struct("seq", "line", "words", "pos")
    listed = shared.groupBy("d").agg(F.collect_list(entry).alias("lines"))       # one document's lines
    wide = cut(windows(listed, min_words))
    homes = wide.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.min("d").alias("home")).filter("n_docs > 1")
    wide = cut(wide.join(homes, "line"))
    often = F.col("n_docs") > rare
    found = shared.filter(away & ~often).select("d", "home") \
        .unionByName(wide.filter(away & ~often).select("d", "home")).distinct()
    whole = found.join(listed.withColumnRenamed("lines", "later"), "d") \
        .join(listed.select(F.col("d").alias("home"), F.col("lines").alias("earlier")), "home")
    one = shared.filter(often).groupBy("line", "home", "d").agg(F.collect_list(entry).alias("lines"))
    common = one.unionByName(wide.filter(often).select("line", "home", "d", "lines"))
    at_home = common.filter(F.col("home") == F.col("d")).select("line", F.col("lines").alias("earlier"))
    apart = common.filter(away).withColumnRenamed("lines", "later")
    grouped = apart.join(at_home, "line").groupBy("d", "home").agg(
        F.flatten(F.collect_list("later")).alias("later"), F.flatten(F.collect_list("earlier")).alias("earlier"))
    gone = align(whole, min_words).unionByName(align(grouped, min_words))
    return gone.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"),
        F.array_sort(F.collect_set("home")).alias("earlier"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5,
               rare: int = 32) -> DataFrame:
    """The rows of ``docs`` with n_lines (lines that are not blank), deleted
    (positions of deleted lines in the text, from 0), earlier (ids of the
    documents they were aligned with) and dedup_text (the text without them).

    * null text: no lines, nothing deleted, dedup_text null; blank lines are
      neither compared nor deleted;
    * a document whose lines are all deleted keeps its blank lines only;
    * a row with a null id is left as it is and takes nothing from others;
    * rows that repeat id and text count as one document and fare alike; rows
      that repeat an id with another text are ordered by the text's hash;
    * input columns named like an output are replaced; an empty table gives
      an empty result.

    One alignment holds the shared lines of two documents, so its memory is
    bounded by the longest document.
    """
    ship(docs.sparkSession)
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    slim = docs.select(ident.alias("doc_id"), text.alias("text")).filter("doc_id is not null and text is not null")
    gone = deletions(slim, min_words, rare).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "deleted", "earlier")
    rows = docs.select(F.struct(*columns(docs, *OUTPUTS)).alias("row"), ident.alias("id"), text.alias("text"))
    joined = rows.join(gone, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    split = F.split("text", "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("deleted", i)), "\n")
    return joined.select(
        "row.*", F.coalesce(F.size(F.filter(split, lambda x: F.length(F.trim(x)) > 0)), F.lit(0)).alias("n_lines"),
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
        F.coalesce("earlier", F.array().cast("array<long>")).alias("earlier"),
        F.when(F.col("deleted").isNull(), F.col("text")).otherwise(left).alias("dedup_text"))


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the shorter texts; documents that lose their last line go."""
    # The other columns go along whole, whatever they are called.
    rows = docs.select(F.struct(*columns(docs, text_col)).alias("input"),
                       F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = line_dedup(rows, "id", "text", **kw)
    emptied = (F.size("deleted") > 0) & (F.length(F.trim(F.regexp_replace("dedup_text", r"\s", ""))) == 0)
    return out.filter(~emptied).select(*[(F.col("dedup_text") if c == text_col else F.col(f"input.`{c}`")).alias(c)
                                         for c in docs.columns])
