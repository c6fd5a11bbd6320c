"""Product catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions.numeric import rnd

def catalog_from_parts(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """K16 over the data: one catalog entry per part.

    ``price`` is the retail price after the part's mean discount,
    ``old_price`` the retail price when a discount applied (NULL otherwise),
    ``stock`` the units sold, and ``tags`` an array of brand, type and a
    "Sale" tag for discounted parts.  Lines are aggregated per part before
    the join, so the join sees one row per part on each side.
    """
    sold = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").cast("long").alias("units"), F.avg("l_discount").alias("disc"))
    j = part.join(sold, "p_partkey", "left")
    disc = F.coalesce(F.col("disc"), F.lit(0.0))
    tags = F.filter(F.array(F.col("p_brand"), F.col("p_type"),
                            F.when(disc > 0, F.lit("Sale"))), lambda t: t.isNotNull())
    return j.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        rnd(F.col("p_retailprice") * (F.lit(1.0) - disc)).alias("price"),
        F.when(disc > 0, F.col("p_retailprice")).alias("old_price"),
        F.lit("USD").alias("currency"),
        F.coalesce(F.col("units"), F.lit(0)).alias("stock"),
        tags.alias("tags"))
