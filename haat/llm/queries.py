"""The contract queries: each runs one operator over its whole table and
derives the columns that the contract asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haat.llm import pfor
from haat.llm.best_fit import best_fit
from haat.llm.collocations import collocations
from haat.llm.common import documents
from haat.llm.exact_dedup import exact_dedup
from haat.llm.langid import identify
from haat.llm.licenses import scan
from haat.llm.line_dedup import line_dedup
from haat.llm.mixing import mix
from haat.llm.orchard import clusters
from haat.llm.packing import pack
from haat.llm.sharding import shard
from haat.llm.simhash import near_dedup
from haat.llm.topk import top_k
from haat.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text")) \
        .select("doc_id", "n_lines", "deleted", "earlier", F.col("dedup_text").alias("text"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_mixing")
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source")).drop("mix_period")


@query("op4_exact_dedup")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("spans")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).withColumn("law", F.lit("bytes")) \
        .withColumn("grown_shard", F.lit(None).cast("int"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), with_ids=False).drop("ids", "loss_tokens")


@query("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = pfor.new_folder(spark)
    return pfor.read(pfor.write(documents(spark, sf_dir), folder), folder)


@query("op10_topk")
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


@query("op11_centroids")
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("n_compared")


@query("op12_best_fit")
def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir), with_ids=False).drop("ids")


@query("op13_collocations")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
