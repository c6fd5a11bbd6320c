"""Out-of-sample errors of the trend forecast (M13, A24), for all origins.

At every day of its history a product's trend is fitted to the days so far
and asked for the days ahead.  Refitting per origin would read the history
once per day; here the moments of the fit (n, sums of t, y, t t, t y) are
running sums by date, so an origin's fit is read off one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd
from haat.operators.daily import as_daily


def origins(tx_or_daily: DataFrame, min_days: int = 30) -> DataFrame:
    """(product, dt, a, b): the line a + b t through the days up to dt, where
    they are ``min_days`` or more; t counts days from the product's first."""
    all_days = Window.partitionBy("product")                  # at most the calendar's days
    so_far = all_days.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = as_daily(tx_or_daily).select("product", "dt", F.col("qty").cast("double").alias("y")) \
        .withColumn("first", F.min("dt").over(all_days)) \
        .withColumn("t", F.datediff("dt", "first").cast("double"))
    t, y = F.col("t"), F.col("y")
    m = d.select("product", "dt", "first", *[F.sum(x).over(so_far).alias(n) for n, x in (
        ("n", F.lit(1.0)), ("st", t), ("sy", y), ("stt", t * t), ("sty", t * y))])
    b = (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / (F.col("n") * F.col("stt") - F.col("st") * F.col("st"))
    return m.filter(F.col("n") >= max(2, min_days)).withColumn("b", b) \
        .select("product", "dt", "first", ((F.col("sy") - F.col("b") * F.col("st")) / F.col("n")).alias("a"), "b")


def rolling_origin_errors(tx_or_daily: DataFrame, horizon: int = 30, min_days: int = 30) -> DataFrame:
    """Per product and days ahead: n forecasts, mean absolute error, bias, and
    the error as a share of the mean.  Days without sales are not scored."""
    daily = as_daily(tx_or_daily)
    ahead = origins(daily, min_days).select("product", "first", "dt", "a", "b",
                                            F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("ahead")) \
        .select("product", "ahead", F.date_add("dt", F.col("ahead")).alias("dt"), (
            F.col("a") + F.col("b") * (F.datediff("dt", "first") + F.col("ahead"))).alias("yhat"))
    scored = ahead.join(daily.select("product", "dt", F.col("qty").cast("double").alias("y")), ["product", "dt"])
    e = F.col("yhat") - F.col("y")
    return scored.groupBy("product", "ahead").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(F.abs(e)), 4).alias("mae"), rnd(F.avg(e), 4).alias("bias"),
        rnd(F.sum(F.abs(e)) / F.sum("y"), 4).alias("share"))
