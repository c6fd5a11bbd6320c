"""Date spines and the seasonal index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import money, rnd, safe_div


def daily_spine(tx: DataFrame) -> DataFrame:
    """Every day of each product's span, gaps filled with 0.

    Each observed day generates itself plus the empty days up to the next
    observed day (``lead`` over the product's days), so the spine comes from
    the daily aggregate alone: one window partitioned by product — bounded
    by the calendar — no second branch and no join back."""
    daily = tx.groupBy("product", "dt").agg(F.sum("quantity").alias("q"),
                                            F.sum("total_amount").alias("rev"))
    nxt = F.lead("dt").over(Window.partitionBy("product").orderBy("dt"))
    span = daily.withColumn("until", F.coalesce(F.date_sub(nxt, 1), F.col("dt")))
    days = span.select("product", F.col("dt").alias("obs"), "q", "rev",
                       F.explode(F.sequence(F.col("dt"), F.col("until"))).alias("dt"))
    first = F.col("dt") == F.col("obs")
    return days.select(
        "product", "dt", F.when(first, F.col("q")).otherwise(F.lit(0)).cast("long").alias("quantity"),
        money(F.when(first, F.col("rev")).otherwise(F.lit(0))).alias("revenue"))


def seasonal_index(tx: DataFrame) -> DataFrame:
    """per product and calendar month, revenue over the product's mean
    month (1.0 = an average month).  The window sees at most 12 rows per
    product."""
    by = tx.groupBy("product", F.month("dt").alias("month")).agg(F.sum("total_amount").alias("rev"))
    mean = F.avg(F.col("rev").cast("double")).over(Window.partitionBy("product"))
    return by.select("product", "month", money(F.col("rev")).alias("revenue"),
                     rnd(safe_div(F.col("rev"), mean), 4).alias("seasonal_index"))


def category_distinct(tx: DataFrame) -> DataFrame:
    """Distinct product names and rows per category."""
    return tx.groupBy("category").agg(F.countDistinct("product_name").alias("n_products"),
                                      F.count(F.lit(1)).alias("n_rows"))
