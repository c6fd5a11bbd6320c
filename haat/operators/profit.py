"""Profit analysis (K5).

The reference's comment says 30 % cost while its code applies a 70 % cost
ratio; the code is what runs, so 0.70 is the default.  Money stays decimal
(``total × 0.70`` is exact), margins are computed once from the sums."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions import labels as L
from haat.functions.numeric import money, rnd, safe_div

COST_RATIO = Decimal("0.70")


def _with_ratio(tx: DataFrame, cost_ratio) -> tuple[DataFrame, object]:
    """The cost ratio as a decimal column: a constant, or looked up in a
    table ``(key, cost_ratio)`` keyed by ``product`` or ``brand`` (rows
    without an entry use 0.70).  The table is one row per key; the join is
    left to Spark's size checks."""
    if isinstance(cost_ratio, DataFrame):
        key = "brand" if "brand" in cost_ratio.columns else "product"
        table = cost_ratio.select(key, F.col("cost_ratio").cast("decimal(5,4)").alias("_ratio"))
        out = tx.join(table, key, "left").withColumn(
            "_ratio", F.coalesce(F.col("_ratio"), F.lit(COST_RATIO).cast("decimal(5,4)")))
        return out, F.col("_ratio")
    return tx, F.lit(Decimal(cost_ratio))


def profit_by_product(tx: DataFrame, cost_ratio=COST_RATIO) -> DataFrame:
    """Revenue, cost, profit, units and margin % per product.
    ``cost_ratio`` is a constant (the reference's 0.70) or a per-product /
    per-brand table, which makes margins differ between products."""
    tx, ratio = _with_ratio(tx, cost_ratio)
    agg = tx.groupBy("product").agg(
        F.sum("total_amount").alias("rev"),
        F.sum(F.col("total_amount") * ratio).alias("cost_dec"),
        F.sum("quantity").alias("quantity"),
    ).withColumn("profit_dec", F.col("rev") - F.col("cost_dec"))
    return agg.select(
        "product",
        money(F.col("rev")).alias("revenue"),
        money(F.col("cost_dec")).alias("cost"),
        money(F.col("profit_dec")).alias("profit"),
        "quantity",
        rnd(safe_div(F.col("profit_dec"), F.col("rev")) * 100.0).alias("margin"),
    )


def top_profitable(tx: DataFrame, n: int = 5, cost_ratio=COST_RATIO) -> DataFrame:
    """Top-n products by profit."""
    return (profit_by_product(tx, cost_ratio)
            .orderBy(F.col("profit").desc(), F.col("product").asc()).limit(n))


def profit_summary(tx: DataFrame, cost_ratio=COST_RATIO) -> DataFrame:
    """K5 one-row summary: total profit, overall margin and the best-margin
    product.  Margins are compared after rounding to 2 places, ties by name,
    so floating-point noise cannot pick the winner."""
    pp = profit_by_product(tx, cost_ratio)
    best = pp.orderBy(F.col("margin").desc(), F.col("product").asc()).limit(1)
    tx, ratio = _with_ratio(tx, cost_ratio)
    tot = tx.agg(F.sum("total_amount").alias("rev"),
                 F.sum(F.col("total_amount") * ratio).alias("cost_dec"))
    profit = F.col("rev") - F.col("cost_dec")
    name = best.select("product").scalar()
    return tot.select(
        rnd(money(profit)).alias("total_profit"),
        rnd(safe_div(profit, F.col("rev")) * 100.0).alias("profit_margin"),
        name.alias("best_margin_product"),
        best.select("margin").scalar().alias("best_margin"),
        F.concat(name, F.lit(L.PROFIT_ADVICE)).alias("recommendation"),
    )
