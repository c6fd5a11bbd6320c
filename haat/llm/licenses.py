"""License scan by diagonal voting.

All rolling word k-grams (k = 2) of every text are joined by hash with the
positions of the same k-grams in license templates; the words themselves are
compared in the join, so a hash never decides alone.  A match at word i of the
text and word j of the template votes for the diagonal i - j.

* A template found word for word has all its votes on one diagonal, and the
  diagonal is the place where it starts.
* An altered notice spreads its votes over neighbouring diagonals, one step
  for each word put in or left out.  Diagonals of a template at most ``slip``
  apart are merged; the span is verified by the share of template k-grams that
  it holds, and counts from ``cover`` on.

The templates are a fixed table of a few hundred rows and the only thing that
is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that make a base label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of public license notices, the method's own templates.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license": "apache",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
    "general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

ALWAYS = -1      # template id of the row that every text matches, so that no text is lost


def words(text: Column) -> Column:
    """The words of a text (null: none), A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))


def template_table(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per template k-gram: hash, w1, w2, tid, tpos, label, base, grams."""
    rows = []
    for base, texts in ((True, phrases), (False, notices)):
        for text, label in texts.items():
            w = text.split()
            if len(w) < 2:
                raise ValueError("templates have two words at least")
            tid = len({r[2] for r in rows})
            rows += [(a, b, tid, j, label, base, len(w) - 1) for j, (a, b) in enumerate(zip(w, w[1:]))]
    rows.append((None, None, ALWAYS, 0, None, False, 1))
    made = spark.createDataFrame(
        rows, "w1 string, w2 string, tid int, tpos int, label string, base boolean, grams int")
    return made.withColumn("hash", gram_hash(F.col("w1"), F.col("w2")))


def gram_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         notices: dict[str, str] | None = None, slip: int = 3, cover: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans.

    ``spans`` lists what was found: label, first word, last word, cover, base.
    ``score`` is the largest cover (1 for a phrase), 0 where nothing votes.

    * null and empty texts have no words and get 0, null and "";
    * texts are scanned whole; rows that repeat an id are scanned each;
    * a null id is carried through; other columns are not read;
    * an empty table gives an empty result.
    """
    templates = template_table(docs.sparkSession, PHRASES if phrases is None else phrases,
                               NOTICES if notices is None else notices)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       words(F.col(text_col)).alias("w")) \
        .withColumn("n_words", F.size("w").cast("long"))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 2),
                        lambda i: gram_hash(F.get("w", i), F.get("w", i + 1)))
    none = F.array(gram_hash(F.lit(None).cast("string"), F.lit(None).cast("string")))
    # Element 0 is the gram of no words, which the ALWAYS row matches.
    all_grams = F.when(F.size("w") > 1, F.concat(none, grams)).otherwise(none)
    rolled = rows.select("row", "doc_id", "n_words", "w", F.posexplode(all_grams).alias("at", "hash"))
    same = (F.col("tid") == ALWAYS) | ((F.get("w", F.col("at") - 1) == F.col("w1")) & (F.get("w", F.col("at")) == F.col("w2")))
    votes = rolled.join(F.broadcast(templates), "hash").filter(same).select(
        "row", "doc_id", "n_words", "tid", "tpos", "label", "base", "grams",
        (F.col("at") - 1 - F.col("tpos")).cast("long").alias("diagonal"))
    keys = ["row", "doc_id", "n_words", "tid", "label", "base", "grams"]
    diagonals = votes.repartition(F.col("row")).groupBy(*keys, "diagonal").agg(
        F.collect_set("tpos").alias("hits"))
    exact = F.size("hits") == F.col("grams")
    # A phrase stands word for word or not at all; notices need two votes on a diagonal.
    diagonals = diagonals.filter(exact | (~F.col("base") & (F.size("hits") >= 2)))
    line = Window.partitionBy("row", "tid").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(line)
    merged = diagonals.withColumn("new", F.when(F.col("base") | step.isNull() | (step > slip), 1).otherwise(0)) \
        .withColumn("cluster", F.sum("new").over(line)) \
        .groupBy(*keys, "cluster").agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("n_hits"),
            F.min(F.col("diagonal") + F.array_min("hits")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("hits") + 1).alias("last"))
    share = F.col("n_hits") / F.col("grams")
    found = (F.col("tid") != ALWAYS) & (share >= cover)
    base = found & F.col("base")
    label_list = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    span = F.when(found, F.struct(F.col("first"), F.col("last"), F.col("label"), share.alias("cover"), F.col("base")))
    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        label_list(base).alias("base_labels"), label_list(found).alias("labels"),
        F.coalesce(F.max(F.when(F.col("tid") != ALWAYS, share)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(span)).alias("spans")).drop("row")
