"""Seasonality (K6): revenue by month number, peak month, top products of the
Eid and winter seasons, and the upcoming-season advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import money

EID_MONTHS = (3, 4, 5)
WINTER_MONTHS = (11, 12, 1, 2)


def revenue_by_month_number(tx: DataFrame) -> DataFrame:
    """Revenue per month number, all years together."""
    return tx.groupBy(F.month("dt").alias("month")).agg(
        money(F.sum("total_amount")).alias("revenue"))


def peak_month(tx: DataFrame) -> DataFrame:
    """Month with the most revenue (ties: lower month), with its label."""
    return (revenue_by_month_number(tx)
            .orderBy(F.col("revenue").desc(), F.col("month").asc()).limit(1)
            .select("month", L.pick(L.MONTHS_BN_SEASON, F.col("month") - 1).alias("name"),
                    "revenue"))


def season_top(tx: DataFrame, n: int = 3, eid=EID_MONTHS, winter=WINTER_MONTHS) -> DataFrame:
    """Top-n products per season.  Rows are aggregated to
    (season, product) before the ranking window, so the window sees at most
    seasons × products rows."""
    m = F.month("dt")
    season = F.when(m.isin(*eid), F.lit("eid")).when(m.isin(*winter), F.lit("winter"))
    agg = (tx.where(m.isin(*eid, *winter))
           .groupBy(season.alias("season"), F.col("product"))
           .agg(money(F.sum("total_amount")).alias("revenue")))
    w = Window.partitionBy("season").orderBy(F.col("revenue").desc(), F.col("product").asc())
    return (agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("season", "rank", "product", "revenue"))


def upcoming_season(dates: DataFrame, col: str = "dt") -> DataFrame:
    """F19 applied to the newest date of ``dates``: one row."""
    latest = dates.agg(F.max(F.col(col).cast("date")).alias("as_of"))
    return latest.select("as_of", F.month("as_of").alias("month"),
                         L.upcoming_season(F.month("as_of")).alias("upcoming_season"))
