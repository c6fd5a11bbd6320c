"""KPI sheet (K1) and its parts: revenue by product (A5), top-k (T1),
two-period comparison per product (J2), trending product (T8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions.numeric import money, pct_change, rnd
from haat.functions.periods import Periods


def revenue_by_product(tx: DataFrame) -> DataFrame:
    """A5: revenue and row count per product (partial + final aggregation)."""
    return tx.groupBy("product").agg(
        money(F.sum("total_amount")).alias("revenue"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def top_products(tx: DataFrame, n: int = 5) -> DataFrame:
    """Top-n products by revenue, ties by name (TakeOrderedAndProject)."""
    return (revenue_by_product(tx)
            .orderBy(F.col("revenue").desc(), F.col("product").asc())
            .limit(n)
            .select("product", "revenue"))


def product_periods(tx: DataFrame, p: Periods) -> DataFrame:
    """One pass, one row per product, every period as a conditional sum.

    Replaces the reference's two filtered scans per product.  Counts are kept
    beside the sums so that "empty window" and "window summing to 0" differ.
    """
    amt = F.col("total_amount")
    dt = F.col("dt")
    return tx.groupBy("product").agg(
        F.sum(amt).alias("total"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(p.last(dt), amt)).alias("last_sum"),
        F.count(F.when(p.last(dt), 1)).alias("last_n"),
        F.sum(F.when(p.previous(dt), amt)).alias("prev_sum"),
        F.count(F.when(p.previous(dt), 1)).alias("prev_n"),
        F.sum(F.when(p.today(dt), amt)).alias("today_sum"),
        F.sum(F.when(p.this_week(dt), amt)).alias("week_sum"),
        F.sum(F.when(p.this_month(dt), amt)).alias("month_sum"),
    )


def period_growth(tx: DataFrame, p: Periods) -> DataFrame:
    """Per product: trailing and previous window revenue and their growth.

    ``growth_pct`` is NULL where the reference leaves the product out of the
    ranking (previous window revenue not positive).
    """
    pp = product_periods(tx, p)
    last = F.coalesce(F.col("last_sum"), F.lit(0))
    prev = F.coalesce(F.col("prev_sum"), F.lit(0))
    return pp.select(
        "product",
        money(last).alias("last30_revenue"),
        money(prev).alias("prev30_revenue"),
        F.when(prev > 0, rnd(pct_change(last, prev))).alias("growth_pct"),
    )


def trending_product(tx: DataFrame, p: Periods) -> DataFrame:
    """The product with the highest growth among those with previous
    revenue > 0; ``('N/A', 0)`` when there is none.  One row."""
    pg = period_growth(tx, p).where(F.col("growth_pct").isNotNull())
    cand = pg.select(F.col("product").alias("name"), F.col("growth_pct").alias("growth"),
                     F.lit(0).alias("_fallback"))
    fallback = tx.sparkSession.range(1).select(
        F.lit("N/A").alias("name"), F.lit(0.0).alias("growth"), F.lit(1).alias("_fallback"))
    return (cand.unionByName(fallback)
            .orderBy("_fallback", F.col("growth").desc(), F.col("name").asc())
            .limit(1)
            .select("name", "growth"))


def kpi_sheet(tx: DataFrame, p: Periods, orders: DataFrame | None = None,
              approx_customers: bool = False) -> DataFrame:
    """K1: the one-row KPI sheet.

    Plan: one grouped pass per product (6 rows out), the order and customer
    counts from ``orders`` (one row per order, ``adapter.order_totals``: no part
    join; by default grouped from ``tx``), and scalar subqueries to put
    the pieces into one row — no cross join.  ``approx_customers`` swaps the
    exact distinct count for HyperLogLog++ (A3 option; no shuffle by user).
    """
    tot = product_periods(tx, p).agg(
        F.sum("total").alias("total"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("last_sum").alias("last_sum"),
        F.sum("last_n").alias("last_n"),
        F.sum("prev_sum").alias("prev_sum"),
        F.sum("prev_n").alias("prev_n"),
        F.sum("today_sum").alias("today_sum"),
        F.sum("week_sum").alias("week_sum"),
        F.sum("month_sum").alias("month_sum"),
    )
    # Each piece is one struct-valued scalar subquery, referenced once, so
    # every sub-plan runs once.
    if orders is None:
        orders = tx.groupBy("transaction_id").agg(F.max("user_id").alias("user_id"))
    orders = (orders.agg(F.struct(F.count(F.lit(1)).alias("n_orders"),
                            (F.approx_count_distinct("user_id") if approx_customers
                             else F.countDistinct("user_id")).alias("n_customers")).alias("s")))
    trend = trending_product(tx, p).select(F.struct("name", "growth").alias("s"))
    last = F.coalesce(F.col("last_sum"), F.lit(0))
    prev = F.when(F.col("prev_n") == 0, F.lit(1)).otherwise(F.col("prev_sum"))
    return tot.select(
        "*", orders.select("s").scalar().alias("_o"), trend.select("s").scalar().alias("_t")
    ).select(
        rnd(money(F.col("total"))).alias("total_revenue"),
        rnd(pct_change(last, prev)).alias("growth_rate"),
        F.col("n_rows").alias("total_orders"),
        rnd(F.try_divide(F.col("total").cast("double"), F.col("_o.n_orders").cast("double")))
        .alias("avg_order_value"),
        F.col("_o.n_customers").alias("unique_customers"),
        rnd(money(F.coalesce(F.col("today_sum"), F.lit(0)))).alias("today_revenue"),
        rnd(money(F.coalesce(F.col("week_sum"), F.lit(0)))).alias("week_revenue"),
        rnd(money(F.coalesce(F.col("month_sum"), F.lit(0)))).alias("month_revenue"),
        F.col("_t.name").alias("trending_product"),
        F.col("_t.growth").alias("trending_growth"),
    )
