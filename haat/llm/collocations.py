"""Phrase collocations by Toivonen's sampling method.

Wanted: per language, every phrase of 2 to ``max_words`` words that occurs
``min_count`` times or more, with exact counts.

* A sample of the documents is counted with a lowered threshold; its frequent
  phrases are the first guess.
* A full pass counts, over all documents, the guessed phrases and the guess's
  negative border together: every occurrence of a phrase whose beginning and
  end (all words but the last, all but the first) are guessed.  Single words
  are all counted.
* Phrases of the border that turn out frequent are border failures: they join
  the guess, and a further pass counts what has come within reach.  Without
  failures the set is closed: a frequent phrase that was never counted would
  have a shortest such part, whose own beginning and end are frequent, hence in
  the guess, hence it was counted.  Where failures are few beside all words, one
  pass counts the whole expansion: beginnings and ends may then be phrases
  that were never counted and are themselves within reach.

The guess is held as a bitmap of 2^27 bits (at most 16 MB, whatever the
corpus; sent compressed), indexed by a phrase's 64-bit hash.  A bit that is set by another phrase only
makes more phrases counted; the argument above holds for the set of bits.
So the sample and the bitmap decide how much is counted, never the result.

The passes count hashes, with the sum of a second hash over all occurrences.
Texts of the frequent ones are looked for in a share of the documents; one
whose second hash explains that sum is the only phrase of its hash.  Hashes
not met there, or shared by two phrases, are counted as texts over all
documents, in Spark's own grouping by (language, text), so that nothing is
lost and rows handed on follow the frequent phrases, not tasks times phrases.

Within a task bytes are split and hashed as arrays, and equal phrases of a
chunk are added up before they leave it.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haat.llm.common import cut, ship, task
from haat.llm.tokens import in_chunks

BITS = 27
BUCKET = 32_768              # bits of one row of Spark's bitmap aggregate
LEVELS = 8                   # a hash's lowest 3 bits hold the number of words
REACH = 64                   # byte positions with a row of random numbers each
CHARS = 1_000_000            # of texts handled at once
FEW = 10                     # failures are few: one occurrence in so many words
TEXTS = 500_000              # phrases a task keeps before it hands them on
NAMED_FROM = (64, 16)        # texts are looked for in one document of so many first

_rng = np.random.default_rng(13)
_BYTE = _rng.integers(0, 1 << 64, REACH * 256, np.uint64)
_FAR = int(_rng.integers(0, 1 << 62)) * 2 + 1
_PLACE = _rng.integers(0, 1 << 63, LEVELS, np.uint64) * np.uint64(2) + np.uint64(1)

WORD, BLANK, STOP = range(3)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = STOP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_SEEDS: dict = {}


def _seed(lang: str) -> int:
    if lang not in _SEEDS:
        _SEEDS[lang] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
    return _SEEDS[lang]


class Words:
    """The words of a chunk of texts, in order: bytes (lower case), where each
    begins and ends, its piece, its text's number, and its hash."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = langs
        raw = [t.encode() for t in texts]
        self.bytes = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        cls = _CLASS[self.bytes]
        edge = np.diff((cls == WORD).astype(np.int8), prepend=np.int8(0))
        self.s, self.e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.text = np.searchsorted(at, self.s, "right") - 1
        self.piece = np.cumsum(cls == STOP, dtype=np.int32)[self.s]
        n = self.e - self.s
        total = int(n.sum())
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        chars = self.bytes[within + np.repeat(self.s, n)]
        value = _BYTE[(within & (REACH - 1)) * 256 + chars]
        far = within >= REACH
        if far.any():
            turn = np.full(int(within.max()) // REACH + 1, _FAR, np.uint64)
            turn[0] = 1
            value[far] *= np.cumprod(turn)[within[far] // REACH]
        self.word = np.add.reduceat(value, np.cumsum(n) - n) if total else np.zeros(0, np.uint64)
        seeds = np.array([_seed(lang) for lang in langs], np.uint64)
        self.lang = seeds[self.text] if len(langs) else np.zeros(0, np.uint64)
        self._sums = [self.lang.copy()]
        self._checks = [self.lang.copy()]
        self._other = _mixed(self.word)

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, is a phrase) of the k words from each word on; those that
        pass a piece's end are none."""
        n = max(0, len(self.word) - k + 1)
        while len(self._sums) <= k:
            j = len(self._sums)
            last = self._sums[-1][:max(0, len(self.word) - j + 1)]
            self._sums.append(last + self.word[j - 1:] * _PLACE[j])
        h = (_mixed(self._sums[k][:n] + np.uint64(k)) & ~np.uint64(LEVELS - 1)) | np.uint64(k)
        return h, self.piece[:n] == self.piece[k - 1:]

    def checks(self, k: int) -> np.ndarray:
        """Second hashes, 28 bits, of the k words from each word on: they keep
        apart phrases that share the first."""
        while len(self._checks) <= k:
            j = len(self._checks)
            last = self._checks[-1][:max(0, len(self.word) - j + 1)]
            self._checks.append(last + self._other[j - 1:] * _PLACE[j])
        return _mixed(self._checks[k]) >> np.uint64(36)

    def phrase(self, i: int, k: int) -> str:
        data = self.bytes[self.s[i]:self.e[i + k - 1]].tobytes().decode()
        return " ".join(w for w in data.replace("\t", " ").split(" ") if w)


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1


class Shared:
    """A bitmap in every task."""

    def __init__(self, spark, bitmap: np.ndarray):
        self.sent = spark.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))
        self._bits = None

    def has(self, h: np.ndarray) -> np.ndarray:
        if self._bits is None:
            self._bits = np.frombuffer(zlib.decompress(self.sent.value), np.uint8)
        return has(self._bits, h)

    def drop(self) -> None:
        """Nothing reads it any more: what was counted with it is written."""
        self.sent.destroy()


def _chunks(batches):
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for some, texts in in_chunks(langs, batch.column(1).to_pylist(), CHARS):
            yield Words(texts, some)


def _counted(words: Words, levels, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, checks = [], []
    for k in levels:
        h, ok = words.hashes(k)
        at = np.flatnonzero(pick(words, k, ok))
        found.append(h[at])
        checks.append(words.checks(k)[at])
    if not found:
        return (np.zeros(0, np.uint64),) * 3
    h, which, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    # At most 2^28 times a chunk's words: exact.
    return h, n, np.bincount(which, np.concatenate(checks), len(h))


def _count(rows: DataFrame, levels, pick, least: int) -> DataFrame:
    """(h, n, s) of the phrases with ``levels`` words that ``pick`` chooses and
    that occur ``least`` times or more; s is the sum of the second hashes of
    all occurrences, n times that of the phrase where h is one phrase's."""
    def run(batches):
        for words in _chunks(batches):
            h, n, s = _counted(words, levels, pick)
            for a in range(0, len(h), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[part].view(np.int64)), pa.array(n[part].astype(np.int64)), pa.array(s[part].astype(np.int64))],
                    ["h", "n", "s"])

    return cut(rows.mapInArrow(task(run), "h long, n long, s long").groupBy("h")
               .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter(F.col("n") >= least))


def _bitmap(counted: DataFrame) -> np.ndarray:
    """The bits of all hashes: at most 4,096 rows of 4 KB."""
    value = F.shiftrightunsigned("h", 64 - BITS) + 1
    rows = counted.select(value.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows:
        out[(r.b - 1) * BUCKET // 8:r.b * BUCKET // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _union(parts: list) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _occurrences(counted: DataFrame, among: Shared | None) -> int:
    def run(batches):
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(n.sum() if among is None else n[among.has(h)].sum())], pa.int64())], ["n"])

    return counted.mapInArrow(task(run), "n long").agg(F.sum("n")).first()[0] or 0


def _both(bits: np.ndarray, n: int) -> np.ndarray:
    """Of phrases one word longer than those of ``bits``: beginning and end are set."""
    return bits[:n] & bits[1:n + 1]


def _first(guess: Shared):
    """All words, the guess and its negative border."""
    def pick(words, k, ok):
        return ok if k == 1 else ok & _both(guess.has(words.hashes(k - 1)[0]), len(ok))
    return pick


def _next(before: Shared, guess: Shared):
    """What the larger guess brings within reach."""
    def pick(words, k, ok):
        h, n = words.hashes(k - 1)[0], len(ok)
        return ok & _both(guess.has(h), n) & ~_both(before.has(h), n)
    return pick


def _expansion(before: Shared, frequent: Shared):
    """Everything that can still be frequent: not counted before, and beginning
    and end are frequent or can still be so themselves."""
    def pick(words, k, ok):
        if k == 2:
            words.can = frequent.has(words.hashes(1)[0])
        n = len(ok)
        counted = _both(before.has(words.hashes(k - 1)[0]), n)
        now = _both(words.can, n) & ~counted & ok
        words.can = now | (counted & frequent.has(words.hashes(k)[0]))
        return now
    return pick


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 5,
                     min_count: int = 100, id_col: str = "doc_id", sample_every: int = 16,
                     sample_least: int | None = None) -> DataFrame:
    """(lang, k, phrase, a): every phrase of 1 to ``max_words`` words with
    count a >= ``min_count``, and a row (k = 0, phrase "") per language with
    the number of its words.  ``sample_every`` (one document in so many) and
    ``sample_least`` decide speed only."""
    if not 1 < max_words < LEVELS:
        raise ValueError(f"max_words must be 2 to {LEVELS - 1}")
    spark = docs.sparkSession
    ship(spark)
    rows_of = [F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")]
    rows = docs.select(*rows_of)
    sample_least = max(1, min_count // (2 * sample_every)) if sample_least is None else sample_least
    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(sample_every)) == 0
    part = docs.filter(drawn).select(*rows_of)

    # The guess: words and pairs of the sample, then longer phrases of its frequent pairs.
    guess = _bitmap(_count(part, (1, 2), lambda w, k, ok: ok, sample_least))
    pairs = Shared(spark, guess)

    def of_pairs(words, k, ok):
        two = pairs.has(words.hashes(2)[0])
        for j in range(k - 1):
            ok = ok & two[j:j + len(ok)]
        return ok

    if max_words > 2:
        guess |= _bitmap(_count(part, range(3, max_words + 1), of_pairs, sample_least))
    pairs.drop()
    reached = Shared(spark, guess)
    found = [_count(rows, range(1, max_words + 1), _first(reached), min_count)]
    while True:
        last = found[-1].filter(F.col("h").bitwiseAND(LEVELS - 1) < max_words)
        grown = guess | _bitmap(last)
        if (grown == guess).all():
            break
        frequent = Shared(spark, _bitmap(_union(found)))
        # Occurrences of failures beside all words: counts of words are in the first pass.
        missed = Shared(spark, grown & ~guess)
        n_missed = _occurrences(last, missed)
        missed.drop()
        whole = n_missed * FEW <= _occurrences(found[0].filter(F.col("h").bitwiseAND(LEVELS - 1) == 1), None)
        new = Shared(spark, grown)
        found.append(_count(rows, range(2, max_words + 1),
                            _expansion(reached, frequent) if whole else _next(reached, new), min_count))
        for old in (reached, frequent):
            old.drop()
        guess, reached = grown, new
        if whole:
            break
    reached.drop()
    return _named(docs, rows_of, [id_col, text_col], _union(found), max_words, min_count)


def _named(docs: DataFrame, rows_of: list, drawn_by: list, found: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """The texts of the counted hashes.  A frequent phrase is met in a share of
    the documents already, so a task hands on few texts; what is not met there,
    and hashes whose second hashes say that several phrases share them, are
    counted as texts over all documents."""
    spark = docs.sparkSession
    rows, names = docs.select(*rows_of), []
    left = found.select("h").distinct()
    for every in NAMED_FROM:
        some = docs.filter(F.pmod(F.xxhash64(*drawn_by), F.lit(every)) == 0).select(*rows_of)
        bits = Shared(spark, _bitmap(left))
        names.append(cut(_first_texts(some, bits, max_words).join(left, "h", "left_semi").groupBy("h").agg(
            F.min(F.struct("lang", "k", "phrase", "c")).alias("t"))))
        bits.drop()
        left = cut(left.join(names[-1], "h", "left_anti"))
    one = F.col("t").isNotNull() & (F.col("s") == F.col("n") * F.col("t.c"))
    told = cut(found.join(_union(names), "h", "left").withColumn("one", F.coalesce(one, F.lit(False))))
    again = cut(told.filter(~F.col("one")).select("h").distinct())
    out = told.filter("one").join(again, "h", "left_anti").select("t.lang", "t.k", "t.phrase", F.col("n").alias("a"))
    if again.limit(1).count():
        bits = Shared(spark, _bitmap(again))
        texts = _texts(rows, bits, max_words, min_count)
        bits.drop()
        out = cut(out.join(texts, ["lang", "k", "phrase"], "left_anti").unionByName(texts))
    return out.unionByName(_totals(rows))


def _first_texts(rows: DataFrame, wanted: Shared, max_words: int) -> DataFrame:
    """(h, c, lang, k, phrase): texts of phrases whose hash is in ``wanted``,
    those a task meets first, with both hashes."""
    def run(batches):
        seen = np.zeros(0, np.uint64)
        for words in _chunks(batches):
            for k in range(1, max_words + 1):
                h, ok = words.hashes(k)
                at = np.flatnonzero(ok)
                at = at[wanted.has(h[at])]
                new, first = np.unique(h[at], return_index=True)
                fresh = ~np.isin(new, seen, assume_unique=True)
                new, at = new[fresh], at[first[fresh]]
                seen = np.concatenate([seen, new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new.view(np.int64)), pa.array(words.checks(k)[at].astype(np.int64)),
                     pa.array([words.langs[words.text[j]] for j in at.tolist()], pa.string()),
                     pa.array([k] * len(at), pa.int32()), pa.array([words.phrase(j, k) for j in at.tolist()], pa.string())],
                    ["h", "c", "lang", "k", "phrase"])
            if len(seen) > TEXTS:
                seen = seen[:0]

    return rows.mapInArrow(task(run), "h long, c long, lang string, k int, phrase string")


def _totals(rows: DataFrame) -> DataFrame:
    """(lang, k = 0, phrase "", a): each language's number of words."""
    def run(batches):
        totals: dict = {}
        for batch in batches:
            for some, texts in in_chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHARS):
                raw = [t.encode() for t in texts]
                word = _CLASS[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)] == WORD
                begins = np.flatnonzero(word & ~np.append(False, word[:-1]))
                ends = np.cumsum([len(r) + 1 for r in raw])
                n = np.diff(np.searchsorted(begins, ends), prepend=0)
                for lang, c in zip(some, n.tolist()):
                    totals[lang] = totals.get(lang, 0) + c
        yield _text_batch([[lang, 0, "", c] for lang, c in totals.items()])

    return cut(rows.mapInArrow(task(run), "lang string, k int, phrase string, a long")
               .groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a")))


class Seen:
    """Phrases a task has met: hashes in order, each with a second hash that
    keeps apart phrases that share the first, the count, and the text's place."""

    def __init__(self):
        self.h = self.check = np.zeros(0, np.uint64)
        self.n = self.place = np.zeros(0, np.int64)
        self.texts: list[tuple] = []

    def add(self, words: Words, k: int, h: np.ndarray, at: np.ndarray) -> list:
        """Count the phrases of k words at ``at``.  Returned are rows for
        phrases whose hash is another one's here."""
        check = words.lang[at] + np.uint64(k)
        for j in range(k):
            check = _mixed(check + words.word[at + j])
        order = np.argsort(h, kind="stable")
        h, check, at = h[order], check[order], at[order]
        runs = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (check[1:] != check[:-1]))[:len(h)])
        n = np.diff(np.append(runs, len(h)))
        h, check, at = h[runs], check[runs], at[runs]
        i = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        known = self.h[i] == h if len(self.h) else np.zeros(len(h), bool)
        same = known & (self.check[i] == check) if len(self.h) else known
        np.add.at(self.n, i[same], n[same])
        first = np.append(True, h[1:] != h[:-1])[:len(h)]
        new, other = ~known & first, ~same & (known | ~first)
        places = np.arange(len(self.texts), len(self.texts) + int(new.sum()))
        self.texts += [(words.langs[words.text[j]], k, words.phrase(j, k)) for j in at[new].tolist()]
        h_all = np.concatenate([self.h, h[new]])
        order = np.argsort(h_all, kind="stable")
        self.h = h_all[order]
        self.check = np.concatenate([self.check, check[new]])[order]
        self.n = np.concatenate([self.n, n[new]])[order]
        self.place = np.concatenate([self.place, places])[order]
        return [[words.langs[words.text[j]], k, words.phrase(j, k), c]
                for j, c in zip(at[other].tolist(), n[other].tolist())]

    def rows(self) -> list:
        return [(*self.texts[p], n) for p, n in zip(self.place.tolist(), self.n.tolist())]


def _texts(rows: DataFrame, frequent: Shared, max_words: int, min_count: int) -> DataFrame:
    """Exact counts of the texts of phrases whose hash is in ``frequent``."""
    def run(batches):
        seen = Seen()
        for words in _chunks(batches):
            for k in range(1, max_words + 1):
                h, ok = words.hashes(k)
                at = np.flatnonzero(ok)
                at = at[frequent.has(h[at])]
                rest = seen.add(words, k, h[at], at)
                if rest:
                    yield _text_batch(rest)
            if len(seen.h) > TEXTS:
                yield _text_batch(seen.rows())
                seen = Seen()
        yield _text_batch(seen.rows())

    counted = rows.mapInArrow(task(run), "lang string, k int, phrase string, a long")
    return cut(counted.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a"))
               .filter(F.col("a") >= min_count))


def _text_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["lang", "k", "phrase", "a"])


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 5,
                 min_count: int = 100, top: int = 2000, contained_pct: int = 100, **sampling) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n,
    score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends,
    and those into words at spaces and tabs.  n is the number of words, a, l
    and r count occurrences within pieces.  Cutting a phrase after a word gives
    floor(1000 a n / (l r)); its lowest cut counts (ties: the first).  Phrases
    that lie inside a longer one with ``contained_pct`` percent of their count
    are left out.  Order: score and a falling, phrase (UTF-8 bytes) rising.

    * null text counts as empty, null lang as "und"; repeated rows count each;
    * texts of any length are counted whole; ties have the order above;
    * an empty table, or none frequent: an empty result; other columns are not
      read, but for ``id_col``, by which the sample is drawn.
    """
    found = frequent_phrases(docs, lang_col, text_col, max_words, min_count, **sampling)
    counts = found.filter("k > 0")
    words = counts.filter("k > 1").withColumn("w", F.split("phrase", " "))
    # Every cut of every candidate, with the counts of both sides.
    cuts = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")) \
        .select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"),
                F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("right"))
    side = counts.select("lang", "phrase", "a")
    cuts = cuts.join(side.toDF("lang", "left", "l"), ["lang", "left"]) \
        .join(side.toDF("lang", "right", "r"), ["lang", "right"]) \
        .join(found.filter("k = 0").select("lang", F.col("a").alias("n")), "lang")
    # 1000 a n passes 64 bits; the quotient is at most 10 n, as l, r >= 100.
    cuts = cuts.withColumn("x", F.lit(1000).cast("decimal(38,0)") * _exact("a") * _exact("n")) \
        .withColumn("y", _exact("l") * _exact("r")).withColumn("score", F.expr("cast(x div y as long)"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # The most frequent longer candidate around each phrase.
    inner = words.filter("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")) \
        .select("lang", "a", F.explode(F.transform(
            F.sequence(F.lit(1), F.col("k") - F.col("m") + 1),
            lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(inner, ["lang", "phrase"], "left") \
        .filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * contained_pct))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), F.col("phrase"))
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n",
                F.col("b.score").alias("score"))
