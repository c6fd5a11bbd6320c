"""Stock cover and alerts (K2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import rnd, safe_div, stock_status, trunc_int
from haat.functions.periods import Periods


def stock_alert(tx: DataFrame, p: Periods, current_stock=100,
                safety_days: int = 7) -> DataFrame:
    """Per product with sales in the trailing window: mean of daily unit
    totals (days with sales only), days until stock-out, reorder point and a
    status band.  The window filter is pushed into the orders scan.

    ``current_stock`` is the reference's fixed 100 units, or a table
    ``(product, stock)`` of actual stock levels (products missing from it
    fall back to 100); it is joined on the per-product result (one row per
    product on both sides)."""
    recent = p.where_last(tx)
    daily = recent.groupBy("product", "dt").agg(F.sum("quantity").alias("q"))
    per = daily.groupBy("product").agg(
        F.sum("q").alias("total_sold_30d"), F.count(F.lit(1)).alias("n_days"))
    if isinstance(current_stock, DataFrame):
        levels = current_stock.select("product", F.col("stock").cast("int").alias("_stock"))
        per = per.join(levels, "product", "left").withColumn(
            "_stock", F.coalesce(F.col("_stock"), F.lit(100)))
    else:
        per = per.withColumn("_stock", F.lit(int(current_stock)))
    avg = safe_div(F.col("total_sold_30d"), F.col("n_days"))
    days = F.when(avg > 0, trunc_int(F.col("_stock").cast("double") / avg)).otherwise(F.lit(999))
    reorder = trunc_int(avg * float(safety_days))
    out = per.select(
        "product",
        F.col("_stock").alias("current_stock"),
        rnd(avg).alias("daily_avg_sales"),
        F.col("total_sold_30d"),
        days.alias("days_until_stockout"),
        reorder.alias("reorder_point"),
    ).withColumn("status", stock_status(F.col("days_until_stockout")))
    return out.withColumn(
        "recommendation",
        F.when(F.col("status") != "ok",
               F.concat(F.lit(L.STOCK_ORDER_PREFIX), F.col("reorder_point").cast("string"),
                        F.lit(L.STOCK_ORDER_SUFFIX)))
        .otherwise(F.lit(L.STOCK_OK)),
    ).withColumn("badge", L.status_badge(F.col("status"))) \
        .orderBy("days_until_stockout", "product")              # T6 (at most one row per product)
