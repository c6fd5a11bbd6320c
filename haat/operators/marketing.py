"""Marketing planner (K7): best campaign day and declining products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import line_count, rnd, safe_div
from haat.functions.periods import Periods
from haat.functions.text import first_two_joined


def best_campaign_day(tx: DataFrame) -> DataFrame:
    """Weekday (Monday = 0) with the highest *mean line* revenue;
    ties go to the earlier weekday."""
    agg = tx.groupBy(F.weekday("dt").alias("day_num")).agg(
        F.sum("total_amount").alias("s"), line_count(tx).alias("n"))
    scored = agg.select("day_num", safe_div(F.col("s"), F.col("n")).alias("mean_raw"))
    return (scored.orderBy(F.col("mean_raw").desc(), F.col("day_num").asc()).limit(1)
            .select("day_num", L.pick(L.WEEKDAYS_BN, F.col("day_num")).alias("day_name"),
                    rnd(F.col("mean_raw")).alias("mean_revenue")))


def declining_products(tx: DataFrame, p: Periods, n: int = 3) -> DataFrame:
    """Products whose trailing revenue is below the previous window.

    A product with no rows in the previous window counts 1 there (and 0 in
    the trailing one), exactly as the reference's dictionary defaults do, so
    a product idle in both windows shows a 100 % decline."""
    dt = F.col("dt")
    amt = F.col("total_amount")
    agg = tx.groupBy("product").agg(
        F.sum(F.when(p.last(dt), amt)).alias("r_sum"),
        F.sum(F.when(p.previous(dt), amt)).alias("o_sum"),
        F.count(F.when(p.previous(dt), 1)).alias("o_n"))
    r = F.coalesce(F.col("r_sum"), F.lit(0)).cast("double")
    o = F.when(F.col("o_n") == 0, F.lit(1)).otherwise(F.col("o_sum")).cast("double")
    dec = agg.where(r < o).select(
        "product", rnd(F.when(o > 0, (o - r) / o * 100.0).otherwise(F.lit(0.0))).alias("decline"))
    return (dec.orderBy(F.col("decline").desc(), F.col("product").asc()).limit(n))


def campaign_plan(tx: DataFrame, p: Periods) -> DataFrame:
    """K7 one-row plan: best day, discount candidates and the advice text."""
    best = best_campaign_day(tx)
    dec = declining_products(tx, p)
    # At most n rows reach collect_list (the ranking already limited them).
    cands = dec.agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("decline")).alias("k"), F.col("product")))),
        lambda s: s["product"]).alias("c"))
    names = cands.select("c").scalar()
    day = best.select("day_name").scalar()
    return best.select(
        F.col("day_name").alias("best_campaign_day"),
        names.alias("discount_recommendations"),
        F.lit(L.RECOMMENDED_DISCOUNT).alias("recommended_discount"),
        F.concat(day, F.lit(L.CAMPAIGN_ADVICE_1), first_two_joined(names),
                 F.lit(L.CAMPAIGN_ADVICE_2)).alias("recommendation"),
    )
