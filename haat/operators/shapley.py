"""Attribution of demand to several features (M12) by Shapley values.

A product's daily units are explained by features with few values each.  The
worth of a coalition of features is the mean over the days that agree with
the day in question on those features.  All coalitions are enumerated (2^f),
each a grouped mean joined back; a feature's value is its weighted gain over
the coalitions without it.  The values of a cell add up to the cell's mean
minus the product's.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd
from haat.operators.pricing import daily_price_demand


def shapley(df: DataFrame, by: list[str], features: list[str], label: str) -> DataFrame:
    """Per group and combination of feature values: n, mean, base (the group's
    mean) and ``phi_<feature>``.  The rows are combined into cells first, so
    the windows see one row per cell."""
    cells = df.groupBy(*by, *features).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("s"))

    def worth(some: tuple) -> Column:
        w = Window.partitionBy(*by, *some)
        return F.sum("s").over(w) / F.sum("n").over(w)

    every = [c for r in range(len(features) + 1) for c in combinations(features, r)]
    valued = cells.select(*by, *features, "n", *[worth(c).alias("v_" + "_".join(c)) for c in every])
    f = len(features)

    def phi(x: str) -> Column:
        total = F.lit(0.0)
        for c in every:
            if x not in c:
                weight = math.factorial(len(c)) * math.factorial(f - len(c) - 1) / math.factorial(f)
                joined = tuple(g for g in features if g in c or g == x)
                total = total + F.lit(weight) * (F.col("v_" + "_".join(joined)) - F.col("v_" + "_".join(c)))
        return total

    return valued.select(*by, *features, "n", F.col("v_" + "_".join(features)).alias("mean"), F.col("v_").alias("base"),
                         *[phi(x).alias(f"phi_{x}") for x in features])


def demand_shapley(tx_or_daily: DataFrame) -> DataFrame:
    """Daily units by price band (against the product's mean price: -1 below
    95 %, 1 above 105 %), weekday and month."""
    mean = F.avg("p").over(Window.partitionBy("product"))
    d = daily_price_demand(tx_or_daily).withColumn("mean_p", mean).select(
        "product", F.when(F.col("p") < 0.95 * F.col("mean_p"), -1).when(F.col("p") > 1.05 * F.col("mean_p"), 1)
        .otherwise(0).alias("price_band"), F.weekday("dt").alias("weekday"), F.month("dt").alias("month"), "q")
    out = shapley(d, ["product"], ["price_band", "weekday", "month"], "q")
    return out.select("product", "price_band", "weekday", "month", "n",
                      *[rnd(F.col(c), 4).alias(c) for c in out.columns[5:]])
