"""Language identification by character language models.

For every language an interpolated Kneser-Ney model of order 4 over letters
(lower-cased; every run of other characters is one space).  Counts cover all
training text: tasks count 4-grams, a shuffle adds them up, and the lower
orders are continuation counts of the 4-gram types, all in Spark.

Where no language has more than ``max_ngrams`` 4-grams, tasks look up the whole
model: keys of one order are kept for all languages together in one sorted
array, found by binary search, beside a matrix with one column per language.
A larger model stays in Spark: tasks hold the probabilities of the most
frequent 4-grams only, the others of each text are joined with the whole
tables, and the logarithms are summed per text.  So ``max_ngrams`` decides
speed, never results.

A text gets the language with the lowest cross-entropy per character.  It is
rejected when it has no letter, or when that cross-entropy is out of reach of
the training texts of its length class: over median + ``reach`` x (99.9 %
quantile - median).  A class (by the power of two of the length, 1,024
characters and more in one) with fewer than ``enough`` training texts takes
the limit of the training texts of all lengths.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haat.llm.common import columns, cut, ship, task
from haat.llm.tokens import in_chunks

SPACE = 32
UNKNOWN = "und"


# --- text to grams -----------------------------------------------------------------

@cache
def letters() -> np.ndarray:
    """UTF-16 unit -> itself for letters and surrogates, 0 for 0, else a space."""
    table = np.full(65536, SPACE, np.uint16)
    for i in range(1, 65536):
        if 0xD800 <= i < 0xE000 or chr(i).isalpha():
            table[i] = i
    table[0] = 0
    return table


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram key, text number) for every character of the texts.  A key holds
    the last four units, 16 bits each; before a text stand spaces."""
    flat = "\0".join([t.replace("\0", " ").lower() for t in texts]).encode("utf-16-le", "surrogatepass")
    m = letters()[np.frombuffer(flat, "<u2")]
    m = np.concatenate([np.zeros(3, np.uint16), m])
    blank = m == SPACE
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & (m[:-1] != 0)
    keep[:3] = True
    m = m[keep].astype(np.uint64)
    of = np.cumsum(m[3:] == 0)
    key, open_ = m[3:].copy(), np.ones(len(m) - 3, bool)
    for back in (1, 2, 3):
        c = m[3 - back:len(m) - back]
        open_ &= c != 0
        key |= np.where(open_, c, np.uint64(SPACE)) << np.uint64(16 * back)
    real = m[3:] != 0
    return key[real].view(np.int64), of[real]


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, key, n) for rows (text, lang): 4-grams of all texts."""
    def run(batches):
        held: dict[str, list] = {}

        def settle(lang):
            keys = np.concatenate([k for k, _ in held[lang]])
            keys, at = np.unique(keys, return_inverse=True)
            held[lang] = [(keys, np.bincount(at, np.concatenate([n for _, n in held[lang]])).astype(np.int64))]

        for batch in batches:
            for langs, texts in in_chunks(batch.column(1).to_pylist(), batch.column(0).to_pylist(), 500_000):
                names = sorted(set(langs))
                keys, of = grams(texts)
                code = np.searchsorted(names, langs)[of] if len(names) else of
                for i, lang in enumerate(names):
                    held.setdefault(lang, []).append(np.unique(keys[code == i], return_counts=True))
                    if sum(len(k) for k, _ in held[lang][1:]) > 300_000:
                        settle(lang)
        for lang in held:
            settle(lang)
            keys, n = held[lang][0]
            for a in range(0, len(keys), 100_000):
                k = keys[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[a:a + 100_000])],
                                                 ["lang", "key", "n"])

    counted = rows.mapInArrow(task(run), "lang string, key long, n long")
    return cut(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")))


# --- the model ---------------------------------------------------------------------

class Table:
    """Sorted keys with a row of values each; keys not there get ``default``."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, default: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.vstack([rows[order], default]).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; the last row where a key is not there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, len(self.keys))


class Model:
    """``orders[n]``: probabilities of n-grams; ``backoff[n]``: of n-gram
    contexts, the weight of the order below (1 where the context is unknown).
    With a ``rest``, ``orders[4]`` has the frequent 4-grams and no more."""

    def __init__(self, langs: list[str]):
        self.langs, self.orders, self.backoff, self.rest = langs, {}, {}, None

    def prob(self, n: int, keys: np.ndarray) -> np.ndarray:
        table = self.orders[n]
        at = table.find(keys)
        out = table.rows[at]
        miss = at == len(table.keys)
        if n > 1 and miss.any():
            k = keys[miss]
            out[miss] = self.lower(n, k)
        return out

    def lower(self, n: int, keys: np.ndarray) -> np.ndarray:
        back = self.backoff[n - 1]
        shorter = keys & ((1 << 16 * (n - 1)) - 1)
        return back.rows[back.find((keys.view(np.uint64) >> np.uint64(16)).view(np.int64))] * self.prob(n - 1, shorter)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy [text, language]) in nats per character."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        keys, of = grams(texts)
        for a in range(0, len(keys), 200_000):
            logs = np.log(self.prob(4, keys[a:a + 200_000]))
            part = of[a:a + 200_000]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            total[part[starts]] -= np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
        n += np.bincount(of, minlength=len(texts))
        return n, total / np.maximum(n, 1)[:, None]

    def partly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(characters, nats of the 4-grams in ``orders[4]`` [text, language],
        the others as (text number, key, count))."""
        total = np.zeros((len(texts), len(self.langs)))
        keys, of = grams(texts)
        table = self.orders[4]
        others = []
        for a in range(0, len(keys), 200_000):
            k, part = keys[a:a + 200_000], of[a:a + 200_000]
            at = table.find(k)
            hit = at < len(table.keys)
            if hit.any():
                starts = np.flatnonzero(np.diff(part[hit], prepend=-1))
                total[part[hit][starts]] -= np.add.reduceat(np.log(table.rows[at[hit]]), starts, axis=0, dtype=np.float64)
            others.append((part[~hit], k[~hit]))
        of_, k = (np.concatenate(x) if others else np.zeros(0, np.int64) for x in (list(zip(*others)) or [(), ()]))
        order = np.lexsort((k, of_))
        of_, k = of_[order], k[order]
        first = np.flatnonzero(np.r_[True, (np.diff(of_) != 0) | (k[1:] != k[:-1])]) if len(k) else np.zeros(0, np.int64)
        n = np.bincount(of, minlength=len(texts))
        return n, total, (of_[first], k[first], np.diff(np.r_[first, len(k)]))


def verdict(n: np.ndarray, h: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, probability, cross-entropy) for cross-entropies h
    [text, language] over n characters; empty texts get the number after the
    last language, 0 and NaN."""
    first = h.argmin(1)
    best = np.where(empty, np.nan, h[np.arange(len(h)), first])
    with np.errstate(invalid="ignore"):
        odds = np.exp(-(h - h.min(1, keepdims=True)) * n[:, None]).sum(1)
    return np.where(empty, h.shape[1], first), np.where(empty, 0.0, 1 / odds), best


def train(rows: DataFrame, max_ngrams: int = 100_000) -> Model:
    """The model of all rows (text, lang), lang not null.  Above ``max_ngrams``
    4-grams of a language its ``rest`` is a ``Tables``, and ``orders[4]`` holds
    the most frequent 4-grams."""
    types = count_grams(rows)
    per_lang = {r.lang: r.c for r in types.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}
    langs = sorted(per_lang)
    col = {x: i for i, x in enumerate(langs)}
    whole_model = max(per_lang.values(), default=0) <= max_ngrams     # lower orders have no more types
    levels = {4: types}
    for n in (3, 2, 1):                      # how many different units come before
        shorter = F.col("key").bitwiseAND((1 << 16 * n) - 1)
        levels[n] = cut(levels[n + 1].groupBy("lang", shorter.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    model = Model(langs)
    for n in (1, 2, 3, 4):
        level = levels[n]
        sizes = level.groupBy("lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("ones"),
                                          F.count(F.when(F.col("n") == 2, 1)).alias("twos"))
        d = np.full(len(langs), 0.5)
        for r in sizes.collect():
            if r.ones and r.twos:
                d[col[r.lang]] = r.ones / (r.ones + 2 * r.twos)
        ctx = F.shiftrightunsigned("key", 16)
        if n == 1:
            ctx = F.lit(0).cast("long")
        contexts = level.groupBy("lang", ctx.alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"))
        if n > 1 and not whole_model:
            if n == 2:
                model.rest = Tables(rows.sparkSession, model)
            model.rest.add(n, level, contexts, d)
            continue
        c_keys, c_lang, (c_n, c_t) = _arrays(contexts, col, "n", "t")
        g_keys, g_lang, (g_n,) = _arrays(level, col, "n")
        weight = d[c_lang] * c_t / np.maximum(c_n, 1)
        back = _table(c_keys, c_lang, weight, len(langs), 1.0)
        whole = _table(c_keys, c_lang, c_n, len(langs), np.inf)
        keys = np.unique(g_keys)
        if n == 1:
            v = len(keys) + 1
            base = np.tile(back.rows[back.find(np.zeros(1, np.int64))][0] / v, (len(keys) + 1, 1))
        else:
            model.backoff[n - 1] = back
            base = model.lower(n, keys) if len(keys) else np.zeros((0, len(langs)))
            base = np.vstack([base, np.zeros(len(langs))])
        own = keys.view(np.uint64) >> np.uint64(16) if n > 1 else np.zeros(len(keys), np.uint64)
        at = np.searchsorted(keys, g_keys)
        total = whole.rows[whole.find(own.view(np.int64))].astype(np.float64)
        seen = np.zeros((len(keys), len(langs)))
        seen[at, g_lang] = np.maximum(g_n - d[g_lang], 0) / total[at, g_lang]
        model.orders[n] = Table(keys, base[:-1] + seen, base[-1])
    if not whole_model:
        model.orders[4] = model.rest.frequent(types, max_ngrams)
    return model


class Tables:
    """The model of orders 2 to 4 as tables in the shared folder: ``probs[n]``
    (key, p) and ``backoff[n]`` (key, b), arrays with one place per language.
    Order 1 has 65,536 units at most."""

    def __init__(self, spark, model: Model):
        self.langs = model.langs
        units = model.orders[1]
        rows = [(int(k), [float(x) for x in p]) for k, p in zip(units.keys, units.rows[:-1])]
        self.probs = {1: F.broadcast(spark.createDataFrame(rows, "key long, p array<double>"))}
        self.backoff: dict[int, DataFrame] = {}
        self.unknown = F.array(*[F.lit(float(x)) for x in units.rows[-1]])
        self.one = F.array(*[F.lit(1.0) for _ in self.langs])

    def add(self, n: int, level: DataFrame, contexts: DataFrame, d: np.ndarray) -> None:
        off = F.lit(None).cast("double")
        for lang, x in zip(self.langs, d):
            off = F.when(F.col("lang") == lang, F.lit(float(x))).otherwise(off)
        back = cut(self._dense(contexts.withColumn("b", off * F.col("t") / F.col("n")), "b", 1.0))
        self.backoff[n - 1] = F.broadcast(back) if n == 2 else back
        totals = contexts.select("lang", F.col("key").alias("_c"), F.col("n").alias("_n"))
        seen = level.withColumn("_c", F.shiftrightunsigned("key", 16)).join(totals, ["lang", "_c"]) \
            .withColumn("s", F.greatest(F.col("n") - off, F.lit(0.0)) / F.col("_n"))
        below = self._below(self._dense(seen, "s", 0.0), n)
        self.probs[n] = cut(below.select("key", F.zip_with(
            "s", self._lower(n, F.col(f"p{n - 1}")), lambda x, y: x + y).alias("p")))

    def _dense(self, table: DataFrame, what: str, default: float) -> DataFrame:
        places = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col(what))), F.lit(default)) for x in self.langs]
        return table.groupBy("key").agg(F.array(*places).alias(what))

    def _below(self, keys: DataFrame, n: int) -> DataFrame:
        """``keys`` with the back-off weight b of their contexts and the
        probabilities of the order below, where these are known."""
        back = self.backoff[n - 1].select(F.col("key").alias("_b"), F.col("b").alias(f"b{n - 1}"))
        less = self.probs[n - 1].select(F.col("key").alias("_p"), F.col("p").alias(f"p{n - 1}"))
        if n == 2:
            back, less = F.broadcast(back), F.broadcast(less)
        own = F.col("key").bitwiseAND((1 << 16 * n) - 1) if n < 4 else F.col("key")
        return keys.join(back, F.shiftrightunsigned(own, 16) == F.col("_b"), "left") \
            .join(less, F.col("key").bitwiseAND((1 << 16 * (n - 1)) - 1) == F.col("_p"), "left").drop("_b", "_p")

    def _lower(self, n: int, p: Column) -> Column:
        return F.zip_with(F.coalesce(F.col(f"b{n - 1}"), self.one), p, lambda x, y: x * y)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """(key, p) for rows (key) of different 4-grams."""
        found = keys.join(self.probs[4].select(F.col("key").alias("_k"), F.col("p").alias("p4")),
                          F.col("key") == F.col("_k"), "left").drop("_k")
        for n in (4, 3, 2):
            found = self._below(found, n)
        p = F.coalesce("p1", self.unknown)
        for n in (2, 3, 4):
            p = F.coalesce(F.col(f"p{n}"), self._lower(n, p))
        return found.select("key", p.alias("p"))

    def frequent(self, types: DataFrame, most: int) -> Table:
        """The probabilities of each language's most frequent 4-grams, at most
        ``most`` to the next power of two in count."""
        power = F.floor(F.log2(F.col("n"))).cast("int")
        least: dict[str, int] = {}
        room = dict.fromkeys(self.langs, most)
        for r in types.groupBy("lang", power.alias("p")).agg(F.count(F.lit(1)).alias("c")) \
                .orderBy(F.col("p").desc()).collect():
            if room[r.lang] >= r.c:
                room[r.lang] -= r.c
                least[r.lang] = 1 << r.p
            else:
                room[r.lang] = -1
        bound = F.lit(None).cast("long")
        for lang, n in least.items():
            bound = F.when(F.col("lang") == lang, F.lit(n)).otherwise(bound)
        some = self.probs[4].join(types.filter(F.col("n") >= bound).select("key").distinct(), "key", "left_semi")
        got = some.toArrow()
        rows = got.column("p").combine_chunks().flatten().to_numpy().reshape(-1, len(self.langs))
        return Table(got.column("key").to_numpy(), rows, np.full(len(self.langs), np.nan))


def _arrays(level: DataFrame, col: dict, *what: str):
    """All rows: keys, language numbers, columns."""
    pdf = level.select("lang", "key", *what).toPandas()
    return pdf["key"].to_numpy(np.int64), pdf["lang"].map(col).to_numpy(np.int64), \
        [pdf[w].to_numpy(np.float64) for w in what]


def _table(keys, lang, value, n_langs: int, default: float) -> Table:
    uniq = np.unique(keys)
    rows = np.full((len(uniq), n_langs), default)
    rows[np.searchsorted(uniq, keys), lang] = value
    return Table(uniq, rows, np.full(n_langs, default))


# --- the operator ------------------------------------------------------------------

def held_out(ident: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a row without id is held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             max_ngrams: int = 100_000, reach: float = 3.0, enough: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, held_out, lang_pred,
    score, n_units, cross_entropy, rejected.

    Models learn from rows that are not held out and have a language.
    ``score`` is the probability of the language given the text, all languages
    being equally likely before.  Ties go to the first language by name.

    * null text, or one without a letter: "und", score 0, rejected;
    * nothing to learn from: "und", score 0, rejected for every row;
    * texts are read whole; rows that repeat an id each get a row;
    * ``max_ngrams`` bounds what tasks hold of the model, not the model;
    * an empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       held_out(F.col(id_col)).alias("held_out"))
    known = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = train(known.select("text", "lang"), max_ngrams)
    rest, model.rest = model.rest, None
    sent = docs.sparkSession.sparkContext.broadcast(model)      # bounded by max_ngrams
    schema = ("doc_id long, text_hash long, held_out boolean, lang string, lang_pred string, score double, "
              "n_units long, cross_entropy double")

    def run(batches):
        from xxhash import xxh64_intdigest
        model = sent.value
        names = np.array([*model.langs, UNKNOWN], object)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64()]
        cols = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))))
            for some, texts in in_chunks(ids, batch.column(1).to_pylist(), 2_000_000 // max(len(model.langs), 4)):
                empty = np.array([not has_letter(t) for t in texts])
                if not model.langs:
                    empty[:] = True
                pred, score = np.full(len(texts), len(model.langs)), np.zeros(len(texts))
                n, best = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
                if not empty.all():
                    n, h = model.score(texts)
                    pred, score, best = verdict(n, h, empty)
                hashes = np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts],
                                  np.uint64).view(np.int64)
                data = [[x[0] for x in some], hashes, [x[1] for x in some], [x[2] for x in some], names[pred], score, n,
                        [None if np.isnan(x) else float(x) for x in best]]
                yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], cols)

    rows = rows.select("doc_id", "text", "held_out", "lang")
    scored = cut(rows.mapInArrow(task(run), schema) if rest is None else _joined(rows, sent, rest, schema))
    length = F.least(F.floor(F.log2(F.greatest("n_units", F.lit(1)))), F.lit(10)).cast("int")
    trained = scored.filter(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")))
    limits = trained.groupBy(length.alias("length")).agg(
        F.percentile_approx("cross_entropy", [0.5, 0.999], 10_000).alias("q"), F.count(F.lit(1)).alias("c")) \
        .filter(F.col("c") >= enough).select("length", (F.col("q")[0] + reach * (F.col("q")[1] - F.col("q")[0])).alias("limit"))
    top = trained.agg(F.percentile_approx("cross_entropy", [0.5, 0.999], 10_000)).first()[0]
    whole = F.lit(top[0] + reach * (top[1] - top[0]) if top else None).cast("double")
    out = scored.withColumn("length", length).join(F.broadcast(limits), "length", "left")     # 11 rows
    limit = F.coalesce("limit", whole)
    return out.withColumn("rejected", F.col("cross_entropy").isNull() | F.coalesce(F.col("cross_entropy") > limit, F.lit(True))) \
        .select("doc_id", "text_hash", "held_out", "lang_pred", "score", "n_units", "cross_entropy", "rejected")


def _joined(rows: DataFrame, sent, rest: Tables, schema: str) -> DataFrame:
    """The scored rows where the model is larger than what tasks hold: nats of
    frequent 4-grams in the task, of all others by a join."""
    langs = rest.langs
    parts_schema = ("row long, key long, n long, nats array<double>, doc_id long, text_hash long, "
                    "held_out boolean, lang string, empty boolean")

    def split(batches):
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest
        model, row = sent.value, TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.bool_(),
                 pa.string(), pa.bool_()]
        names = [c.split()[0] for c in parts_schema.split(", ")]
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))))
            for some, texts in in_chunks(ids, batch.column(1).to_pylist(), 2_000_000 // max(len(langs), 4)):
                n, nats, (of, keys, times) = model.partly(texts)
                hashes = np.array([xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in texts],
                                  np.uint64).view(np.int64)
                number = row + np.arange(len(texts))
                row += len(texts)
                data = [number, [None] * len(texts), n, nats.tolist(), [x[0] for x in some], hashes,
                        [x[1] for x in some], [x[2] for x in some], [not has_letter(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds)], names)
                for a in range(0, len(keys), 100_000):
                    part = slice(a, a + 100_000)
                    data = [number[of[part]], keys[part], times[part]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, k) for d, k in zip(data, kinds)] + [pa.nulls(len(keys[part]), k) for k in kinds[3:]],
                        names)

    def judge(batches):
        from itertools import chain
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            if not len(batch):
                continue
            n, empty = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
            nats = np.array(list(chain.from_iterable(batch.column(2).to_pylist()))).reshape(-1, len(langs))
            pred, score, best = verdict(n, nats / np.maximum(n, 1)[:, None], empty)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], pa.array(names[pred], pa.string()), pa.array(score), pa.array(n, pa.int64()),
                 pa.array([None if np.isnan(x) else float(x) for x in best], pa.float64())],
                [c.split()[0] for c in schema.split(", ")])

    parts = cut(rows.mapInArrow(task(split), parts_schema))
    others = parts.filter("key is not null").select("row", "key", "n")
    probs = cut(rest.look_up(others.select("key").distinct()))
    more = others.join(probs, "key").groupBy("row").agg(
        F.array(*[F.sum(-F.col("n") * F.log(F.col("p")[i])) for i in range(len(langs))]).alias("more"))
    texts = parts.filter("key is null").drop("key").join(more, "row", "left")
    nats = F.when(F.col("more").isNull(), F.col("nats")).otherwise(F.zip_with("nats", "more", lambda x, y: x + y))
    return texts.select("n", "empty", nats.alias("nats"), "doc_id", "text_hash", "held_out", "lang") \
        .mapInArrow(task(judge), schema)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject."""
    bad = identify(docs, id_col, text_col, **kw).filter("rejected").select(
        F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # The input row goes along whole, whatever its columns are called.
    rows = docs.select(F.struct(*columns(docs)).alias("input"), F.col(f"`{id_col}`").alias("id"),
                       F.xxhash64(text).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash"))
    return rows.join(bad, same, "left_anti").select("input.*")
