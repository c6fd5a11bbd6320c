"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing,
packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  ``run`` writes each stage to a folder that all executors share
and hands the reread table to the next, so a lost executor costs at most one
stage's work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haat.llm.common import columns, documents, shared_dir
from haat.llm.langid import accepted
from haat.llm.line_dedup import rewritten
from haat.llm.mixing import mix
from haat.llm.packing import pack
from haat.llm.simhash import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents left without any."""
    return rewritten(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays
    (with several rows of that id, all of them; rows without id stay where no
    row of their group has one)."""
    found = near_dedup(docs)
    stays = found.filter(found.doc_id.eqNullSafe(found.component_id)).select(found.doc_id.alias("stays")).distinct()
    rows = docs.select(F.struct(*columns(docs)).alias("input"), "doc_id")
    return rows.join(stays, rows.doc_id.eqNullSafe(stays.stays), "left_semi").select("input.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule; the input row goes along
    whole, whatever its columns are called."""
    rows = docs.select(F.struct(*columns(docs)).alias("input"), "source", "doc_id")
    return mix(rows).orderBy("mix_position", "mix_place").select("input.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1,024 tokens, with their ids.  Files of
    the stage before are read in any order, so the schedule, which depends on
    the rows alone, is worked out again: the sort's partitions follow it, and
    sequence ids follow the partitions."""
    return pack(mixing(spark, docs, sf_dir))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("mixing", mixing),
    ("packing", packing),
]

# Language models, alignment and packing have no SQL; tests/llm holds the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
