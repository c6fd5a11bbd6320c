"""Exact dedup by skew-safe combining (DataFrame operations only).

Texts are equal when they are identical after each run of ASCII white space
is replaced by one space.  Three stages find the groups, and each groups by
(digest, whole text), so a digest never decides alone:

1. *local*: the map side of the first aggregation leaves one row per text and
   input task, however many copies the task read;
2. *salted*: the rows of a digest go to ``salts`` places, by input task;
3. *global*: the salt winners of a digest, at most ``salts`` for one text,
   meet and give the smallest id and the number of rows.

Only slim rows (id, digest) are then joined with the groups.  If the third
stage has seen two texts with one digest, those digests are joined on the
whole text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haat.llm.common import cut

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def text_groups(texts: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, text) -> keep_id, group_size, for rows (doc_id, digest, text)."""
    local = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.repartition(F.col("digest")).groupBy("digest", "text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    * null text counts as empty; empty texts form a group like any other;
    * of equal texts the smallest id stays; a null id stays only where no row
      of the group has an id (keep_id is then null);
    * rows that repeat an id and its text share one fate (all kept or all
      dropped) and are counted in group_size each;
    * an empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    # Decided per digest; n_texts > 1 marks a digest that two texts share.
    by_text = text_groups(texts, salts)
    groups = cut(by_text.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_texts"), F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size")))
    slim = texts.select("doc_id", "digest")
    clear = groups.filter("n_texts = 1").drop("n_texts")
    shared = groups.filter("n_texts > 1").select("digest")
    out = slim.join(clear, "digest")
    if not shared.isEmpty():
        same = shared.join(by_text, "digest")
        out = out.unionByName(texts.join(same, ["digest", "text"]).drop("text"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
