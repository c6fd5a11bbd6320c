"""Product comparison (K8/A17) and comparison statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions.numeric import rnd, safe_div


def parse_products(param: str) -> list[str]:
    """P16 for a request parameter: ``'a, b'`` → ``['a', 'b']``."""
    return [p.strip() for p in param.split(",")]


def _restrict(tx: DataFrame, products) -> DataFrame:
    """A short list is an ``IN`` filter (pushed to the scan where the
    column comes from one); a DataFrame of products is a ``left_semi`` join,
    so long lists never pass through the driver."""
    if isinstance(products, DataFrame):
        return tx.join(products.select(F.col(products.columns[0]).alias("product")).distinct(),
                       "product", "left_semi")
    if isinstance(products, str):
        products = parse_products(products)
    return tx.where(F.col("product").isin(list(products)))


def compare_products(tx: DataFrame, products) -> DataFrame:
    """Units, mean price, line count and mean units per requested
    product; requested products without sales are left out."""
    agg = _restrict(tx, products).groupBy("product").agg(
        F.sum("quantity").alias("total_sales"),
        F.sum("price").alias("p_sum"),
        F.count(F.lit(1)).alias("transaction_count"))
    return agg.select(
        "product", "total_sales",
        rnd(safe_div(F.col("p_sum"), F.col("transaction_count"))).alias("avg_price"),
        "transaction_count",
        rnd(safe_div(F.col("total_sales"), F.col("transaction_count"))).alias("avg_quantity"))


def comparison_stats(tx: DataFrame, products) -> DataFrame:
    """Units sum/mean/sample std and price mean/sample std, rounded to 2
    places; std is NULL for a single row (pandas gives NaN)."""
    agg = _restrict(tx, products).groupBy("product").agg(
        F.sum("quantity").alias("qty_sum"),
        F.avg("quantity").alias("qty_mean"),
        F.stddev_samp("quantity").alias("qty_std"),
        F.avg("price").alias("price_mean"),
        F.stddev_samp("price").alias("price_std"))
    return agg.select("product", "qty_sum", rnd(F.col("qty_mean")).alias("qty_mean"),
                      rnd(F.col("qty_std")).alias("qty_std"),
                      rnd(F.col("price_mean")).alias("price_mean"),
                      rnd(F.col("price_std")).alias("price_std"))
