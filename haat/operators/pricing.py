"""Pricing (M2–M4, M11, M12, K10).

The reference trains a reinforcement-learning agent whose reward is
``-|new - current|`` and whose fallback action is 0; both leave the price
unchanged.  Here the action grid ``-5…5`` (price × (1 + a/10)) is an explicit
scenario table per product and the choice is an arg-max over it:

* ``parity``  — the reference's reward, so the optimum is action 0;
* ``elastic`` — the user guide's intent: demand follows a constant
  elasticity fitted on daily data, profit uses the 70 % cost ratio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd, safe_div
from haat.operators.daily import as_daily

ACTIONS = (-5, 5)
COST_RATIO = 0.70


def daily_price_demand(tx_or_daily: DataFrame) -> DataFrame:
    """Per product-day: units sold and mean unit price (from the daily cube)."""
    d = as_daily(tx_or_daily)
    return d.select("product", "dt", F.col("qty").cast("double").alias("q"),
                    (F.col("price_sum") / F.col("n_rows")).alias("p"))


def current_price(tx_or_daily: DataFrame) -> DataFrame:
    """Mean unit price per product (unrounded)."""
    d = as_daily(tx_or_daily)
    return d.groupBy("product").agg(
        safe_div(F.sum("price_sum"), F.sum("n_rows")).alias("current_raw"))


def _grid(df: DataFrame) -> DataFrame:
    """M2: the 11 price actions per product (a literal ``sequence``)."""
    return df.withColumn("action", F.explode(F.sequence(F.lit(ACTIONS[0]), F.lit(ACTIONS[1]))))


def _best(scored: DataFrame, score: str) -> DataFrame:
    """Arg-max of ``score`` per product; ties go to the smaller |action|,
    then the lower action.  The window sees 11 rows per product."""
    w = Window.partitionBy("product").orderBy(
        F.col(score).desc(), F.abs(F.col("action")).asc(), F.col("action").asc())
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def price_parity(tx: DataFrame) -> DataFrame:
    """Current and "optimised" price with the reference's reward."""
    g = _grid(current_price(tx)).withColumn(
        "new_raw", F.col("current_raw") * (F.lit(1.0) + F.col("action") / 10.0))
    g = g.withColumn("reward", -F.abs(F.col("new_raw") - F.col("current_raw")))
    b = _best(g, "reward")
    return b.select("product", rnd(F.col("current_raw")).alias("current_price"), "action",
                    rnd(F.col("new_raw")).alias("optimized_price"))


def price_elastic(tx: DataFrame, cost_ratio: float = COST_RATIO) -> DataFrame:
    """M4: elasticity = slope of ln(units) on ln(price) over product-days;
    expected units at each grid price ``q̄ · f^e``, profit
    ``(p̄·f − cost_ratio·p̄) · q̄ · f^e``; the best action, flagged when it
    sits on the grid edge (inelastic demand makes the highest price win).

    One aggregation per product over the daily cube gives slope, mean units
    and current price; the grid is exploded in place and the arg-max window
    reuses the same partitioning (one exchange in all)."""
    d = as_daily(tx)
    q = F.col("qty").cast("double")
    p = F.col("price_sum") / F.col("n_rows")
    base = d.groupBy("product").agg(
        F.regr_slope(F.log(q), F.log(p)).alias("e"), F.avg(q).alias("q_bar"),
        safe_div(F.sum("price_sum"), F.sum("n_rows")).alias("current_raw"))
    f = F.lit(1.0) + F.col("action") / 10.0
    g = _grid(base).withColumn("price_raw", F.col("current_raw") * f)
    g = g.withColumn("qty_raw", F.col("q_bar") * F.pow(f, F.col("e")))
    g = g.withColumn("profit_raw", (F.col("price_raw") - F.lit(cost_ratio) * F.col("current_raw"))
                     * F.col("qty_raw"))
    g = g.withColumn("profit_r", rnd(F.col("profit_raw")))
    b = _best(g, "profit_r")
    return b.select("product", rnd(F.col("e"), 4).alias("elasticity"),
                    rnd(F.col("current_raw")).alias("current_price"),
                    F.col("action").alias("best_action"), rnd(F.col("price_raw")).alias("best_price"),
                    rnd(F.col("qty_raw")).alias("expected_quantity"),
                    F.col("profit_r").alias("expected_profit"),
                    (F.abs(F.col("action")) == ACTIONS[1]).alias("at_grid_edge"))


def regression_fit(tx: DataFrame) -> DataFrame:
    """M11 (single feature): daily units on mean price per product."""
    d = daily_price_demand(tx)
    return d.groupBy("product").agg(
        rnd(F.regr_slope("q", "p"), 4).alias("slope"),
        rnd(F.regr_intercept("q", "p"), 4).alias("intercept"),
        rnd(F.regr_r2("q", "p"), 4).alias("r2"),
        F.regr_count("q", "p").alias("n"))


def price_attribution(tx: DataFrame) -> DataFrame:
    """Linear attribution of each product-day's price to its demand,
    ``slope · (p − mean p)`` (what a linear explainer reports).  Slope and
    mean are window aggregates per product (no join back)."""
    d = daily_price_demand(tx)
    P = Window.partitionBy("product")
    slope = F.regr_slope("q", "p").over(P)
    return d.select("product", "dt", rnd(F.col("p")).alias("price"),
                    rnd(slope * (F.col("p") - F.avg("p").over(P)), 4).alias("attribution"))


def fit_linear_model(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """M11 with any number of features: ``pyspark.ml`` least squares
    (distributed normal equations), returned as a small table of
    ``term, coefficient`` rows plus ``r2`` and ``n`` on every row.

    The fit itself runs as Spark jobs over ``df``; only the fitted
    coefficients (one per feature) come back to build the result table.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(
        df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double").alias("_y"))
    ).select("_x", "_y")
    model = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal",
                             regParam=0.0, elasticNetParam=0.0).fit(data)
    s = model.summary
    terms = list(zip(["intercept", *features], [float(model.intercept), *map(float, model.coefficients)]))
    return df.sparkSession.createDataFrame(
        [(t, c, float(s.r2), int(s.numInstances)) for t, c in terms],
        "term string, coefficient double, r2 double, n long")
