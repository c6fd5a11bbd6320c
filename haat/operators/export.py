"""Exports (S7–S9, S11): the sheets of the sales export as DataFrames and
writers that put each sheet into its own folder.

The xlsx container itself is a single-machine format and is not produced;
the content of every sheet is, as Parquet or CSV written in parallel."""

from __future__ import annotations

import datetime as _dt
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions.labels import date_text
from haat.functions.numeric import money, rnd
from haat.session import scratch_dir


def date_bounds(tx: DataFrame, start=None, end=None) -> DataFrame:
    """Optional inclusive start/end bounds on ``dt``."""
    conds = []
    if start is not None:
        conds.append(F.col("dt") >= F.lit(_as_date(start)))
    if end is not None:
        conds.append(F.col("dt") <= F.lit(_as_date(end)))
    return tx.where(reduce(lambda a, b: a & b, conds)) if conds else tx


def _as_date(v):
    return _dt.date.fromisoformat(v) if isinstance(v, str) else v


def sales_rows(tx: DataFrame, start=None, end=None) -> DataFrame:
    """The "Sales Data" sheet: the rows in range."""
    return date_bounds(tx, start, end).select(
        "transaction_id", "dt", "product", "product_name", "quantity",
        rnd(F.col("price")).alias("price"), money(F.col("total_amount")).alias("total_amount"),
        "user_id", "discount_applied")


def export_summary(tx: DataFrame, start=None, end=None) -> DataFrame:
    """A14: "Summary Statistics" — units sum/mean/count, price mean/min/max."""
    agg = date_bounds(tx, start, end).groupBy("product").agg(
        F.sum("quantity").alias("qty_sum"), F.avg("quantity").alias("qty_mean"),
        F.count("quantity").alias("qty_count"), F.avg("price").alias("price_mean"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"))
    return agg.select("product", "qty_sum", rnd(F.col("qty_mean")).alias("qty_mean"), "qty_count",
                      rnd(F.col("price_mean")).alias("price_mean"),
                      rnd(F.col("price_min")).alias("price_min"),
                      rnd(F.col("price_max")).alias("price_max"))


def export_daily(tx: DataFrame, start=None, end=None) -> DataFrame:
    """A16: "Daily Sales" — units and mean price per (date, product)."""
    agg = date_bounds(tx, start, end).groupBy("dt", "product").agg(
        F.sum("quantity").alias("quantity"), F.avg("price").alias("price"))
    return agg.select("dt", "product", "quantity", rnd(F.col("price")).alias("price"))


def write_sales_export(tx: DataFrame, out_dir: str, start=None, end=None,
                       fmt: str = "parquet") -> dict[str, str]:
    """The three sheets, each written as its own dataset."""
    # The joined rows are written once; the three sheets are derived from them.
    staged = scratch_dir(tx.sparkSession, "sales-export-rows")
    date_bounds(tx, start, end).select("transaction_id", "dt", "product", "product_name", "quantity", "price",
                                       "total_amount", "user_id", "discount_applied").write.parquet(staged)
    rows = tx.sparkSession.read.parquet(staged)
    sheets = {"sales_data": sales_rows(rows), "summary_statistics": export_summary(rows), "daily_sales": export_daily(rows)}
    paths = {}
    for name, df in sheets.items():
        path = os.path.join(out_dir, name)
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
        paths[name] = path
    return paths


def forecast_report_lines(forecast: DataFrame) -> DataFrame:
    """The text report as lines (one per forecast row plus a header per
    product), ready for ``write.text``; no row goes through the driver."""
    body = forecast.select(
        "product", F.col("ds"),
        F.format_string("%s  yhat=%s  lower=%s  upper=%s", date_text(F.col("ds")),
                        F.col("yhat").cast("string"), F.col("yhat_lower").cast("string"),
                        F.col("yhat_upper").cast("string")).alias("value"))
    head = forecast.select("product").distinct().select(
        "product", F.lit(None).cast("date").alias("ds"),
        F.concat(F.lit("=== Demand Forecast Report ===\nProduct: "), F.col("product")).alias("value"))
    return body.unionByName(head)


def write_forecast_report(forecast: DataFrame, out_dir: str) -> str:
    """One text folder per product (``product=<name>/part-*.txt``)."""
    lines = forecast_report_lines(forecast)
    (lines.repartition("product").sortWithinPartitions("product", F.col("ds").asc_nulls_first())
     .select("product", "value").write.mode("overwrite").partitionBy("product").text(out_dir))
    return out_dir


def read_sheets(spark, paths: dict[str, str]) -> DataFrame:
    """The rows of written sheets in one frame: ``sheet`` and the columns of
    all of them (null where a sheet has none of that name)."""
    parts = [spark.read.parquet(p).withColumn("sheet", F.lit(n)) for n, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_comparison_export(tx: DataFrame, products, out_dir: str) -> dict[str, str]:
    """Comparison statistics plus one folder per product, by its full name."""
    from haat.operators.compare import _restrict, comparison_stats
    stats_path = os.path.join(out_dir, "comparison")
    comparison_stats(tx, products).write.mode("overwrite").parquet(stats_path)
    rows_path = os.path.join(out_dir, "products")
    # One file or a few per sheet, and a sheet with most rows is written by many tasks.
    (_restrict(tx, products).withColumn("sheet", F.col("product"))
     .withColumn("salt", F.pmod(F.xxhash64("transaction_id"), F.lit(8))).repartition("sheet", "salt").drop("salt")
     .write.mode("overwrite").partitionBy("sheet").parquet(rows_path))
    return {"comparison": stats_path, "products": rows_path}


def records_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON object (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))
