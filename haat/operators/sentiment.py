"""Sentiment and search interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import clamp, rnd, safe_div

# Our own small valence lexicon (VADER-like scale −4…4).  It is a parameter:
# pass another one to ``lexicon_sentiment`` for real use.
LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "best": 3.2, "better": 1.9, "comfy": 1.5, "durable": 1.2,
    "educational": 1.2, "excellent": 2.7, "fast": 1.0, "fresh": 1.3, "good": 1.9,
    "great": 3.1, "happy": 2.7, "helpful": 1.8, "love": 3.2, "lovely": 2.8, "nice": 1.8,
    "perfect": 2.7, "recommended": 1.5, "safe": 1.9, "useful": 1.9, "value": 1.4,
    "wonderful": 2.7, "affordable": 1.3, "fine": 0.8, "glad": 2.0, "like": 1.5,
    "bad": -2.5, "broken": -2.0, "cheap": -0.8, "damaged": -2.2, "disappointed": -2.3,
    "fake": -2.2, "hate": -2.7, "late": -1.1, "poor": -2.1, "problem": -1.7, "refund": -1.0,
    "slow": -1.3, "terrible": -2.9, "useless": -2.4, "waste": -2.2, "worst": -3.1,
    "wrong": -2.1, "awful": -2.9, "sad": -2.1, "angry": -2.3, "error": -1.5,
}
NORMALIZATION_ALPHA = 15.0


def tokens(text):
    """Lower-cased letter runs of the whole text (no prefix, no cap)."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}]+"), lambda t: t != "")


def lexicon_sentiment(docs: DataFrame, lexicon: dict[str, float] | None = None, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Sum of word valences per document, normalised with
    ``s / sqrt(s² + 15)`` and clamped to [0.35, 0.95] like the ingestion.

    Everything happens in the row: the tokens stay in their array, those that
    are in the literal word set are kept, and only they are looked up and
    added.  No join, no shuffle.
    """
    lexicon = LEXICON if lexicon is None else lexicon
    valence = F.create_map(*[F.lit(x) for item in sorted(lexicon.items()) for x in item])
    words = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    hits = F.filter("words", lambda w: w.isin(*sorted(lexicon)))
    out = docs.select(F.col(id_col), words.alias("words")).select(
        id_col, F.size("words").cast("long").alias("n_tokens"), hits.alias("hits"))
    out = out.select(id_col, "n_tokens", F.size("hits").cast("long").alias("n_hits"), F.aggregate(
        "hits", F.lit(0.0), lambda s, w: s + F.element_at(valence, w)).alias("s"))
    s = F.col("s")
    compound = s / F.sqrt(s * s + F.lit(NORMALIZATION_ALPHA))
    return out.select(id_col, "n_tokens", "n_hits", rnd(s, 4).alias("score"),
                      rnd(compound, 4).alias("compound"),
                      rnd(clamp(compound, 0.35, 0.95), 4).alias("sentiment"))


def sentiment_mean(sent: DataFrame) -> DataFrame:
    """Mean sentiment per product."""
    return sent.groupBy("product").agg(rnd(F.avg("sentiment"), 4).alias("sentiment"),
                                       F.count(F.lit(1)).alias("n"))


def sentiment_series(sent: DataFrame) -> DataFrame:
    """The per-product daily series in date order (``seq`` = position).

    Scores are averaged per (product, date) first; the numbering window then
    sees one row per product-day only."""
    daily = sent.groupBy("product", "date").agg(F.avg("sentiment").alias("s"))
    w = Window.partitionBy("product").orderBy("date")
    return daily.select("product", "date", F.row_number().over(w).alias("seq"),
                        rnd(F.col("s"), 4).alias("sentiment"))


def week_ending_sunday(d):
    """Weekly label of a date: the Sunday that ends its Monday-based week."""
    return F.date_add(F.date_trunc("week", d).cast("date"), 6)


def weekly_sentiment(sent: DataFrame) -> DataFrame:
    """One row per product and Sunday over the product's span; weeks
    without scores are kept with NULL sentiment.  Each observed week also
    emits the empty weeks up to the next observed one (``lead`` over the
    product's weeks): one window, no cross join, no join back."""
    wk = sent.withColumn("week", week_ending_sunday(F.col("date")))
    agg = wk.groupBy("product", "week").agg(F.avg("sentiment").alias("s"),
                                            F.count(F.lit(1)).alias("n"))
    nxt = F.lead("week").over(Window.partitionBy("product").orderBy("week"))
    span = agg.withColumn("until", F.coalesce(F.date_sub(nxt, 7), F.col("week")))
    weeks = span.select("product", F.col("week").alias("obs"), "s", "n", F.explode(
        F.sequence(F.col("week"), F.col("until"), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    first = F.col("week") == F.col("obs")
    return weeks.select("week", "product", rnd(F.when(first, F.col("s")), 4).alias("sentiment"),
                        F.when(first, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_scores"))


def interest_index(events: DataFrame) -> DataFrame:
    """Daily event counts per type, scaled so each type's peak day is 100.

    The scaling window sees one row per (type, day) — bounded by the calendar,
    not by the number of events."""
    daily = events.groupBy(F.col("event_type").alias("product"),
                           F.col("ts").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n_events"))
    peak = F.max("n_events").over(Window.partitionBy("product"))
    return daily.select("product", "date", "n_events",
                        rnd(safe_div(F.col("n_events") * 100, peak)).alias("interest"))
