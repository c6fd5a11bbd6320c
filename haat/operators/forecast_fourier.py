"""Demand forecast with change points and Fourier seasons (M1's option).

Per product, daily units are explained by a trend whose slope may change at
fixed places of the product's span, and by sine and cosine pairs of the year
and the week.  All products are fitted in one job: the daily cube's products
of regressors are summed per product and solved per product
(``least_squares``); the cube is read twice, facts once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd
from haat.operators.daily import as_daily
from haat.operators.forecast import ORIGIN, Z80
from haat.operators.least_squares import normal_equations, solve

CHANGE_POINTS = (0.25, 0.5, 0.75)     # of the product's span
YEARLY, WEEKLY = 2, 3                 # pairs of sine and cosine
RIDGE = 1e-3                          # keeps short histories solvable


def regressors(day: Column, first: Column, last: Column) -> dict[str, Column]:
    t = F.datediff(day, F.lit(ORIGIN)).cast("double")
    u = F.datediff(day, first) / F.greatest(F.datediff(last, first), F.lit(1)).cast("double")
    out = {"trend": u} | {f"change_{c}": F.greatest(u - F.lit(c), F.lit(0.0)) for c in CHANGE_POINTS}
    for name, period, pairs in (("year", 365.25, YEARLY), ("week", 7.0, WEEKLY)):
        for j in range(1, pairs + 1):
            angle = t * F.lit(2.0 * math.pi * j / period)
            out |= {f"{name}_sin_{j}": F.sin(angle), f"{name}_cos_{j}": F.cos(angle)}
    return out


def forecast_fourier(tx_or_daily: DataFrame, horizon: int = 30, z: float = Z80, min_days: int = 10) -> DataFrame:
    """``product, ds, yhat, yhat_lower, yhat_upper`` for the ``horizon`` days
    after each product's last date; products with fewer than ``min_days``
    days have none.  The band is z residual standard deviations."""
    span = Window.partitionBy("product")      # at most the calendar's days
    daily = as_daily(tx_or_daily).select("product", "dt", F.col("qty").cast("double").alias("y")) \
        .withColumn("first", F.min("dt").over(span)).withColumn("last", F.max("dt").over(span))
    sums = normal_equations(daily, ["product", "first", "last"], regressors(*map(F.col, ("dt", "first", "last"))),
                            F.col("y"))
    fitted = solve(sums.filter(F.col("n") >= min_days), ["product", "first", "last"], RIDGE, centred=False)
    days = fitted.select("*", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("ds"))
    yhat = F.element_at("beta", 1)
    for i, x in enumerate(regressors(*map(F.col, ("ds", "first", "last"))).values()):
        yhat = yhat + F.element_at("beta", i + 2) * x
    band = F.lit(z) * F.sqrt(F.col("sse") / F.greatest(F.col("n") - 1, F.lit(1)))
    return days.select("product", "ds", yhat.alias("yhat"), band.alias("band")).select(
        "product", "ds", rnd(F.col("yhat"), 4).alias("yhat"), rnd(F.col("yhat") - F.col("band"), 4).alias("yhat_lower"),
        rnd(F.col("yhat") + F.col("band"), 4).alias("yhat_upper"))
