"""Sales trends (K3): weekday pattern, best day, monthly revenue, month over month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import money, pct_change, rnd


def weekday_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per weekday that has sales (Monday = 0)."""
    return tx.groupBy(L.weekday_num(F.col("dt")).alias("day_num")).agg(
        F.sum("total_amount").alias("revenue_dec"))


def weekday_pattern(tx: DataFrame) -> DataFrame:
    """All seven days Monday…Sunday, days without sales at 0.

    The fixed 7-row spine is a literal range; it joins the 7-row aggregate."""
    spine = tx.sparkSession.range(7).select(F.col("id").cast("int").alias("day_num"))
    agg = weekday_revenue(tx)
    return (spine.join(agg, "day_num", "left")
            .select("day_num",
                    L.pick(L.WEEKDAYS_EN, F.col("day_num")).alias("day"),
                    money(F.coalesce(F.col("revenue_dec"), F.lit(0))).alias("revenue")))


def best_day(tx: DataFrame) -> DataFrame:
    """Weekday with the highest revenue among days with sales; ties go
    to the alphabetically first name (the reference scans names in order)."""
    agg = weekday_revenue(tx).select(
        L.pick(L.WEEKDAYS_EN, F.col("day_num")).alias("day"),
        money(F.col("revenue_dec")).alias("revenue"))
    return (agg.orderBy(F.col("revenue").desc(), F.col("day").asc()).limit(1)
            .withColumn("recommendation", F.concat(F.col("day"), F.lit(L.TRENDS_ADVICE))))


def monthly_revenue(tx: DataFrame) -> DataFrame:
    """Revenue per calendar month (first day of the month)."""
    return tx.groupBy(F.trunc(F.col("dt"), "month").alias("month")).agg(
        money(F.sum("total_amount")).alias("revenue"))


def mom_growth(tx: DataFrame) -> DataFrame:
    """Growth of the newest month with sales against the one before it;
    0 when fewer than two months exist or the previous one is not positive.

    Only the two newest monthly rows are kept (TakeOrderedAndProject), so no
    window has to see all months in one partition."""
    last2 = (tx.groupBy(F.trunc(F.col("dt"), "month").alias("month"))
             .agg(F.sum("total_amount").alias("rev"))
             .orderBy(F.col("month").desc()).limit(2))
    agg = last2.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("month").alias("latest_month"),
        F.max_by("rev", "month").alias("latest"),
        F.min("month").alias("prev_month"),
        F.min_by("rev", "month").alias("prev"),
    )
    two = F.col("n") >= 2
    return agg.select(
        "latest_month",
        money(F.col("latest")).alias("latest_revenue"),
        F.when(two, F.col("prev_month")).alias("prev_month"),
        F.when(two, money(F.col("prev"))).alias("prev_revenue"),
        F.when(two, rnd(pct_change(F.col("latest"), F.col("prev")))).otherwise(F.lit(0.0))
        .alias("mom_growth"),
    )
