"""One call per reference endpoint, with the same request parameters.

A user of the reference's HTTP API can switch to these methods: each
returns a DataFrame (or writes an export and returns its paths).  Nothing
here is a server; the methods only fix parameters and pick the operator.
Product filters are applied on grouping or window keys, which Catalyst
pushes below the aggregation, so a per-product call reads only that
product's groups after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haat.operators import (compare, context, customers, export, forecast, graph, kpi, marketing,
                            pricing, profit, recommend, seasonal, sentiment, stock, trends)
from haat.operators.daily import daily_stats
from haat.plans.context import Ctx
from haat.sources import adapter
from haat.sources.catalog import catalog_from_parts
from haat.sources.tables import table


class Dashboard:
    """The analytics endpoints over one data folder (``sf_dir``)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of=None):
        self.ctx = Ctx(spark, sf_dir, as_of)
        self._daily: DataFrame | None = None

    @property
    def daily(self) -> DataFrame:
        if self._daily is None:
            self._daily = daily_stats(self.ctx.tx)
        return self._daily

    # --- model endpoints ---------------------------------------------------------
    def forecast(self, product: str = "clothing") -> DataFrame:
        """/api/forecast?product=…"""
        return forecast.forecast(self.daily).where(F.col("product") == product)

    def price(self, product: str = "clothing") -> DataFrame:
        """/api/price?product=…"""
        return pricing.price_parity(self.daily).where(F.col("product") == product)

    def price_details(self, product: str = "clothing") -> DataFrame:
        """/api/price_details?product=… (prices plus per-day attribution)."""
        att = pricing.price_attribution(self.daily).where(F.col("product") == product)
        return self.price(product).join(att.drop("price"), "product", "left")

    def recommend(self, user_id: int = 1, n: int = 5) -> DataFrame:
        """/api/recommend?user_id=… (the popularity list, as the reference
        serves it; ``recommend.recommend_als`` gives personal lists)."""
        return recommend.recommend_popular(self.daily, n).withColumn("user_id", F.lit(user_id))

    def graph(self, product: str = "clothing") -> dict[str, DataFrame]:
        """/api/graph?product=…: insight, nodes and edges."""
        e = graph.edges(self.ctx.tx)
        return {"insights": graph.insights(e).where(F.col("product") == product),
                "nodes": graph.nodes(e), "edges": e}

    def products(self) -> DataFrame:
        """/api/products (the catalog derived from the data)."""
        return catalog_from_parts(table(self.ctx.spark, self.ctx.sf_dir, "part"),
                                  table(self.ctx.spark, self.ctx.sf_dir, "lineitem"))

    def social(self, product: str = "clothing") -> DataFrame:
        """/api/social?product=…"""
        return sentiment.sentiment_mean(self._sent()).where(F.col("product") == product)

    def social_series(self, product: str = "clothing") -> DataFrame:
        """/api/social_series?product=…"""
        return sentiment.sentiment_series(self._sent()).where(F.col("product") == product)

    def _sent(self) -> DataFrame:
        return adapter.social_sentiment(self.ctx.spark, self.ctx.sf_dir)

    # --- exports -------------------------------------------------------------------
    def export_excel(self, out_dir: str, start_date=None, end_date=None) -> dict[str, str]:
        """/api/export/excel?start_date=…&end_date=… (three sheet folders)."""
        return export.write_sales_export(self.ctx.tx, out_dir, start_date, end_date)

    def export_forecast(self, out_dir: str, product: str = "clothing") -> str:
        """/api/export/forecast?product=…"""
        return export.write_forecast_report(self.forecast(product), out_dir)

    # --- analytics -------------------------------------------------------------------
    def kpis(self) -> dict[str, DataFrame]:
        """/api/analytics/kpis"""
        return {"sheet": kpi.kpi_sheet(self.ctx.tx, self.ctx.periods, self.ctx.orders),
                "top_products": kpi.top_products(self.ctx.lines)}

    def stock_alert(self, current_stock=100) -> DataFrame:
        """/api/stock/alert"""
        return stock.stock_alert(self.ctx.tx, self.ctx.periods, current_stock)

    def trends(self) -> dict[str, DataFrame]:
        """/api/trends/analysis"""
        o = self.ctx.orders
        return {"best_day": trends.best_day(o), "weekly_pattern": trends.weekday_pattern(o),
                "mom_growth": trends.mom_growth(o)}

    def customer_insights(self) -> dict[str, DataFrame]:
        """/api/customer/insights"""
        o = self.ctx.orders
        return {"summary": customers.customer_summary(o, self.ctx.as_of),
                "top_customers": customers.top_customers(o, self.ctx.as_of)}

    def profit_analysis(self, cost_ratio=profit.COST_RATIO) -> dict[str, DataFrame]:
        """/api/profit/analysis"""
        lines = self.ctx.lines
        return {"summary": profit.profit_summary(lines, cost_ratio),
                "top_profitable": profit.top_profitable(lines, 5, cost_ratio)}

    def seasonal_predictor(self) -> dict[str, DataFrame]:
        """/api/seasonal/predictor"""
        tx = self.ctx.tx
        return {"peak_month": seasonal.peak_month(self.ctx.orders), "season_top": seasonal.season_top(tx),
                "upcoming_season": seasonal.upcoming_season(
                    table(self.ctx.spark, self.ctx.sf_dir, "orders"), "o_orderdate")}

    def marketing_planner(self) -> DataFrame:
        """/api/marketing/planner"""
        return marketing.campaign_plan(self.ctx.tx, self.ctx.periods)

    def compare(self, products: str = "clothing,electronics") -> DataFrame:
        """/api/compare?products=a,b"""
        return compare.compare_products(self.ctx.lines, products)

    def chat_context(self, product: str = "clothing") -> DataFrame:
        """The data block the chat endpoints send with a prompt."""
        return context.dashboard_context(
            self.ctx.tx, adapter.product_sentiment(self.ctx.spark, self.ctx.sf_dir), self.daily).where(
            F.col("product") == product)
