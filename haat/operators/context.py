"""Dashboard context (K15): one text block per product, built from the
forecast, price, recommendation, sentiment and graph results by joins on
``product`` — each input is computed once for all products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haat.functions.numeric import fmt2
from haat.operators import forecast, graph, pricing, recommend, sentiment
from haat.operators.daily import daily_stats


def dashboard_context(tx: DataFrame, sent: DataFrame, daily: DataFrame | None = None) -> DataFrame:
    """``daily`` is the daily cube of ``tx``; forecast,
    price and popularity read it, only the graph needs the facts again."""
    daily = daily if daily is not None else daily_stats(tx)
    prods = recommend.popularity(daily).select("product")
    fc = forecast.forecast_latest(daily).select("product", F.col("yhat").alias("f_yhat"))
    pr = pricing.price_parity(daily).select("product", "current_price", "optimized_price")
    se = sentiment.sentiment_mean(sent).select("product", F.col("sentiment").alias("s_avg"))
    gi = graph.insight_text(graph.edges(tx))
    # the whole recommendation line is built inside one scalar subquery
    # (at most 5 names are collected), referenced once below
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "product"))),
                                     lambda s: s["product"]), ", ")
    recs = (recommend.recommend_popular(daily, 5).agg(names.alias("r"))
            .select(F.when(F.col("r") != "", F.concat(F.lit("Top recommendations: "), F.col("r")))
                    .alias("line")))
    j = (prods.join(fc, "product", "left").join(pr, "product", "left")
         .join(se, "product", "left").join(gi, "product", "left"))
    rec_line = recs.select("line").scalar()
    parts = [
        F.coalesce(F.concat(F.lit("Forecast (next period) yhat="), fmt2(F.col("f_yhat"))),
                   F.lit("Forecast: unavailable")),
        F.coalesce(F.concat(F.lit("Price: current="), fmt2(F.col("current_price")),
                            F.lit(", optimized="), fmt2(F.col("optimized_price"))),
                   F.lit("Price: unavailable")),
        rec_line,
        F.coalesce(F.concat(F.lit("Social sentiment (avg): "), fmt2(F.col("s_avg"))),
                   F.lit("Social sentiment: unavailable")),
        F.concat(F.lit("Graph: "), F.coalesce(F.col("insight"), F.lit("No relations"))),
    ]
    return j.select("product", F.concat_ws("\n", *parts).alias("context"))
