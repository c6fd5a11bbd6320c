"""Demand forecast for all products at once.

The reference fits one Prophet model per request.  Here one Spark job fits
every product: a linear trend, then a weekday effect and a month effect as
mean residuals, and an 80 % band of ±1.2816 residual standard deviations
(the default interval width of the public Prophet API).  The horizon is
generated directly (no tail needed).

Grain: ``'day'`` fits one observation per product-day (its unit total);
``'row'`` fits one observation per transaction row, as the reference feeds
its model.  Both are computed from the daily cube (``operators.daily``):
a row-grain fit only needs, per day, the number of rows ``w``, the sum
``sy`` and the sum of squares ``syy`` of the units — ordinary least squares,
group means and the residual variance are all weighted sums of these.  So
the raw facts are read once, whatever the grain, and every later step works
on at most products × days rows — as window aggregates over a single hash
partitioning by product (see ``fit``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd
from haat.operators.daily import as_daily

ORIGIN = _dt.date(2000, 1, 1)
Z80 = 1.2816


def _t(d):
    return F.datediff(d, F.lit(ORIGIN)).cast("double")


def forecast_input(tx: DataFrame, product: str) -> DataFrame:
    """One product's rows as the ``(ds, y)`` frame a forecaster takes."""
    return tx.where(F.col("product") == product).select(
        F.col("dt").alias("ds"), F.col("quantity").alias("y"))


def observations(daily: DataFrame, grain: str = "day") -> DataFrame:
    """Per product-day: weight ``w``, ``sy``, ``syy`` of the observations."""
    qty = F.col("qty").cast("double")
    if grain == "day":
        w, sy, syy = F.lit(1.0), qty, qty * qty
    elif grain == "row":
        w, sy, syy = F.col("n_rows").cast("double"), qty, F.col("qty_sq").cast("double")
    else:
        raise ValueError("grain must be 'day' or 'row'")
    return daily.select("product", "dt", w.alias("w"), sy.alias("sy"), syy.alias("syy"),
                        F.col("n_rows"), _t(F.col("dt")).alias("t"),
                        F.weekday("dt").alias("wd"), F.month("dt").alias("mo"))


def fit(tx_or_daily: DataFrame, grain: str = "day", min_rows: int = 10,
        horizon: int = 0) -> dict[str, DataFrame]:
    """Trend (centred least squares), weekday and month effects and residual
    spread, all as window aggregates over the daily observations.

    Plan: one exchange by ``product``; every later window is partitioned by
    ``product`` or a superset of it, so the same hash partitioning serves
    them all and no further shuffle happens.  Each window holds the days of
    one product — bounded by the calendar, not by the number of rows.

    With ``horizon > 0`` the next ``horizon`` days after each product's last
    observation are appended with weight 0: they change no sum, and they
    pick up their weekday and month effects from the same windows (an effect
    without observations is NULL and counts as 0).
    """
    obs = observations(as_daily(tx_or_daily), grain).withColumn("future", F.lit(False))
    if horizon:
        ends = obs.groupBy("product").agg(F.max("dt").alias("last"))
        fut = ends.select("product", F.explode(F.sequence(
            F.date_add("last", 1), F.date_add("last", horizon))).alias("dt"))
        fut = fut.select("product", "dt", F.lit(0.0).alias("w"), F.lit(0.0).alias("sy"),
                         F.lit(0.0).alias("syy"), F.lit(0).cast("long").alias("n_rows"),
                         _t(F.col("dt")).alias("t"), F.weekday("dt").alias("wd"),
                         F.month("dt").alias("mo"), F.lit(True).alias("future"))
        obs = obs.unionByName(fut)
    P = Window.partitionBy("product")
    PW = Window.partitionBy("product", "wd")
    PM = Window.partitionBy("product", "mo")
    w, t, sy = F.col("w"), F.col("t"), F.col("sy")
    g = (obs.withColumn("N", F.sum(w).over(P))
         .withColumn("n_rows_p", F.sum("n_rows").over(P))
         .withColumn("last_dt", F.max(F.when(~F.col("future"), F.col("dt"))).over(P)))
    g = g.where(F.col("n_rows_p") >= min_rows)                       # P13 guard
    g = (g.withColumn("tbar", F.sum(w * t).over(P) / F.col("N"))
         .withColumn("ybar", F.sum(sy).over(P) / F.col("N")))
    dev = t - F.col("tbar")
    g = (g.withColumn("Sxx", F.sum(w * dev * dev).over(P))
         .withColumn("Sxy", F.sum(dev * sy).over(P)))
    g = g.withColumn("b", F.when(F.col("Sxx") > 0, F.col("Sxy") / F.col("Sxx")))
    g = g.withColumn("a", F.col("ybar") - F.col("b") * F.col("tbar"))
    g = g.withColumn("r1", sy - w * (F.col("a") + F.col("b") * t))
    wsum = F.sum(w).over(PW)
    g = g.withColumn("w_eff", F.when(wsum > 0, F.sum("r1").over(PW) / wsum))
    g = g.withColumn("r2", F.col("r1") - w * F.coalesce(F.col("w_eff"), F.lit(0.0)))
    msum = F.sum(w).over(PM)
    g = g.withColumn("m_eff", F.when(msum > 0, F.sum("r2").over(PM) / msum))
    g = g.withColumn("c", F.col("a") + F.col("b") * t + F.coalesce(F.col("w_eff"), F.lit(0.0))
                     + F.coalesce(F.col("m_eff"), F.lit(0.0)))
    # per day: sum and sum of squares of the residuals y_i - c (0 for future rows)
    s1 = sy - w * F.col("c")
    s2 = F.when(w == 1.0, s1 * s1).otherwise(
        F.col("syy") - 2.0 * F.col("c") * sy + w * F.col("c") * F.col("c"))
    g = g.withColumn("s1", s1).withColumn("s2", s2)
    S, SS = F.sum("s1").over(P), F.sum("s2").over(P)
    var = F.greatest(F.lit(0.0), (SS - S * S / F.col("N")) / (F.col("N") - 1.0))
    g = g.withColumn("sigma", F.when(F.col("N") > 1, F.sqrt(var)))
    past = g.where(~F.col("future"))
    return {
        "frame": g,
        "resid": past.select("product", "dt", "w", "sy", "c", "s1", "s2"),
        "trend": past.groupBy("product").agg(F.max("last_dt").alias("last_dt"), F.max("b").alias("b"),
                                             F.max("a").alias("a")),
        "weekday": past.groupBy("product", "wd").agg(F.max("w_eff").alias("w_eff")),
        "month": past.groupBy("product", "mo").agg(F.max("m_eff").alias("m_eff")),
        "sigma": past.groupBy("product").agg(F.max("sigma").alias("sigma")),
    }


def forecast(tx_or_daily: DataFrame, horizon: int = 30, grain: str = "day", z: float = Z80,
             min_rows: int = 10, raw: bool = False) -> DataFrame:
    """``product, ds, yhat, yhat_lower, yhat_upper`` for the ``horizon`` days
    after each product's last observed date."""
    g = fit(tx_or_daily, grain, min_rows, horizon)["frame"].where(F.col("future"))
    yhat = F.col("c")
    band = F.lit(z) * F.coalesce(F.col("sigma"), F.lit(0.0))
    out = g.select("product", F.col("dt").alias("ds"), yhat.alias("yhat"),
                   (yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper"))
    if raw:
        return out
    return out.select("product", "ds", rnd(F.col("yhat")).alias("yhat"),
                      rnd(F.col("yhat_lower")).alias("yhat_lower"),
                      rnd(F.col("yhat_upper")).alias("yhat_upper"))


def forecast_mean(tx_or_daily: DataFrame, horizon: int = 30, grain: str = "day") -> DataFrame:
    """Mean of the horizon's forecasts per product."""
    f = forecast(tx_or_daily, horizon, grain, raw=True)
    return f.groupBy("product").agg(rnd(F.avg("yhat")).alias("mean_yhat"),
                                    F.count(F.lit(1)).alias("horizon"))


def forecast_latest(tx_or_daily: DataFrame, horizon: int = 30, grain: str = "day") -> DataFrame:
    """The last forecast row per product (``max_by(yhat, ds)``)."""
    f = forecast(tx_or_daily, horizon, grain, raw=True)
    return f.groupBy("product").agg(F.max("ds").alias("ds"), F.max_by("yhat", "ds").alias("yhat"))


def error_by_group(tx_or_daily: DataFrame) -> DataFrame:
    """Mean absolute in-sample error of the day-grain model per
    product (the sensitive group) plus the overall value (``'__overall__'``)."""
    r = fit(tx_or_daily, "day")["resid"]
    per = r.groupBy(F.col("product").alias("group")).agg(
        F.sum(F.abs("s1")).alias("abs_sum"), F.count(F.lit(1)).alias("n"))
    overall = per.agg(F.lit("__overall__").alias("group"), F.sum("abs_sum").alias("abs_sum"),
                      F.sum("n").alias("n"))
    both = per.unionByName(overall)
    return both.select("group", "n", rnd(F.col("abs_sum") / F.col("n"), 4).alias("mae"))

