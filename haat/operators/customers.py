"""Customer insight (K4): RFM per user, top customers, summary."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import line_count, money, rnd, safe_div


def rfm(tx: DataFrame, as_of: _dt.date) -> DataFrame:
    """Recency (days since the last purchase), frequency (rows) and
    monetary value (exact sum) per user — one grouped pass.  Works on line
    rows or on ``order_totals`` (one row per order, lines pre-summed)."""
    return tx.groupBy("user_id").agg(
        F.datediff(F.lit(as_of), F.max("dt")).alias("recency"),
        line_count(tx).alias("frequency"),
        F.sum("total_amount").alias("monetary_dec"),
    ).select("user_id", "recency", "frequency", money(F.col("monetary_dec")).alias("monetary"))


def top_customers(tx: DataFrame, as_of: _dt.date, n: int = 5) -> DataFrame:
    """The n biggest spenders, ties by user id."""
    return (rfm(tx, as_of).orderBy(F.col("monetary").desc(), F.col("user_id").asc()).limit(n)
            .select(F.col("user_id").alias("customer_id"),
                    F.col("monetary").alias("total_spent"),
                    F.col("frequency").alias("orders")))


def customer_summary(tx: DataFrame, as_of: _dt.date, at_risk_days: int = 60) -> DataFrame:
    """Customer count, mean lifetime value and users idle > 60 days."""
    r = tx.groupBy("user_id").agg(
        F.datediff(F.lit(as_of), F.max("dt")).alias("recency"),
        F.sum("total_amount").alias("monetary_dec"))
    agg = r.agg(F.count(F.lit(1)).alias("total_customers"),
                F.sum("monetary_dec").alias("spend"),
                F.count_if(F.col("recency") > at_risk_days).alias("at_risk_customers"))
    return agg.select(
        "total_customers",
        rnd(safe_div(F.col("spend"), F.col("total_customers"))).alias("avg_ltv"),
        "at_risk_customers",
        F.concat(F.col("at_risk_customers").cast("string"), F.lit(L.CUSTOMERS_ADVICE))
        .alias("recommendation"),
    )
