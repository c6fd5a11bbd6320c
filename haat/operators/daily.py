"""The daily cube: sufficient statistics per (product, day).

Forecasting, pricing, regression and popularity only need, per product and
day, the row count, the unit sum, the sum of squared units, the price sum
and the revenue.  This table has at most products × calendar days rows no
matter how many transactions there are.  It is one aggregation over the
fact table (combined map-side), planned together with what reads it: where a
query reads it twice, Spark reuses the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stats(tx: DataFrame) -> DataFrame:
    q = F.col("quantity")
    return tx.groupBy("product", "dt").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(q).alias("qty"),
        F.sum(q.cast("long") * q).alias("qty_sq"),
        F.sum("price").alias("price_sum"),
        F.sum("total_amount").alias("amount"),
    )


def as_daily(tx_or_daily: DataFrame) -> DataFrame:
    """Accept either the fact table or an already built daily cube."""
    return tx_or_daily if "n_rows" in tx_or_daily.columns and "qty_sq" in tx_or_daily.columns \
        else daily_stats(tx_or_daily)
