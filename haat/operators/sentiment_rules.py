"""Sentiment with rules (M14): negations and boosters around a word.

A word's valence depends on the words before it.  Going back over the three
words before a hit,

* a booster moves its valence away from zero (or, with a negative strength,
  towards it); it counts in full next to the hit, 95 % one word further off,
  90 % at the third place;
* a negation among the three turns the valence round and weakens it.

The rules are tables (word, value); they are parameters like the lexicon.
Everything happens in the row: positions of hits are filtered first, and only
those look back.  No join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haat.functions.numeric import clamp, rnd
from haat.operators.sentiment import LEXICON, NORMALIZATION_ALPHA, tokens

# Published weights of booster distance and of negation.
DAMPING = (1.0, 0.95, 0.9)
NEGATED = -0.74


@dataclass(frozen=True)
class Rules:
    lexicon: dict[str, float] = field(default_factory=lambda: dict(LEXICON))
    boosters: dict[str, float] = field(default_factory=lambda: {
        "very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "too": 0.293, "highly": 0.293,
        "totally": 0.293, "slightly": -0.293, "somewhat": -0.293, "hardly": -0.293, "barely": -0.293, "kind": -0.293})
    negations: tuple[str, ...] = ("not", "no", "never", "none", "nobody", "nothing", "without", "cannot", "nor")


def _looked_up(values: dict[str, float], word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in sorted(values.items()) for x in item])
    return F.coalesce(F.when(word.isin(*sorted(values)), F.element_at(table, word)), F.lit(0.0)) if values else F.lit(0.0)


def _valence(words: Column, i: Column, rules: Rules) -> Column:
    """Of the hit at place ``i`` (from 0)."""
    v = _looked_up(rules.lexicon, F.get(words, i))
    before = [F.get(words, i - F.lit(d)) for d in (1, 2, 3)]
    boost = F.lit(0.0)
    for weight, w in zip(DAMPING, before):
        boost = boost + F.lit(weight) * _looked_up(rules.boosters, w)
    negated = F.lit(False)
    for w in before:
        negated = negated | F.coalesce(w.isin(*rules.negations), F.lit(False)) if rules.negations else negated
    return (v + F.signum(v) * boost) * F.when(negated, F.lit(NEGATED)).otherwise(F.lit(1.0))


def rule_sentiment(texts: DataFrame, ids: list[str], text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """ids, n_tokens, n_hits, n_negated, score, compound, sentiment: as
    ``lexicon_sentiment``, with the rules.  Null text counts as empty; texts of
    any length are read whole."""
    rules = rules or Rules()
    words = F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))
    rows = texts.select(*ids, words.alias("w"))
    places = F.filter(F.transform("w", lambda w, i: F.when(w.isin(*sorted(rules.lexicon)), i)), lambda i: i.isNotNull())
    rows = rows.select(*ids, F.size("w").cast("long").alias("n_tokens"), "w", places.alias("at"))
    scored = rows.select(*ids, "n_tokens", F.transform("at", lambda i: F.struct(
        _valence(F.col("w"), i, rules).alias("v"),
        F.exists(F.slice("w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))),
                 lambda w: w.isin(*rules.negations) if rules.negations else F.lit(False)).alias("neg"))).alias("hits"))
    out = scored.select(*ids, "n_tokens", F.size("hits").cast("long").alias("n_hits"),
                        F.size(F.filter("hits", lambda h: h["neg"])).cast("long").alias("n_negated"),
                        F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["v"]).alias("s"))
    s = F.col("s")
    compound = s / F.sqrt(s * s + F.lit(NORMALIZATION_ALPHA))
    return out.select(*ids, "n_tokens", "n_hits", "n_negated", rnd(s, 4).alias("score"), rnd(compound, 4).alias("compound"),
                      rnd(clamp(compound, 0.35, 0.95), 4).alias("sentiment"))
