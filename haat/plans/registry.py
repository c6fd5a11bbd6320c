"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the adapter, runs over the whole
tables, and returns a lazily planned DataFrame.  Parameters that the
reference takes from the request are fixed here to the values below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window

from pyspark.sql import functions as F

from haat.operators import (backtest, bootstrap, compare, copurchase, customers, customers_window, export, forecast_fourier, graph,
                            kpi, least_squares, marketing, neighbours, pricing, profit, recommend, recommend_quality,
                            seasonal, sentiment,
                            sentiment_rules, shapley, spine, stock, text, trends, vectors)
from haat.operators import context as ctxop
from haat.functions.numeric import rnd
from haat.functions.text import reply_text
from haat.operators import forecast as fc
from haat.operators.daily import daily_stats
from haat.plans.context import Ctx
from haat.schemas import DAILY_SALES
from haat.session import scratch_dir
from haat.sources import adapter, files
from haat.sources.catalog import catalog_from_parts
from haat.sources.tables import table

# Request parameters of the registered queries.
COMPARE_PRODUCTS = "PROMO, STANDARD, clothing"
RANGE_START, RANGE_END = "1998-01-01", "1998-12-31"
FORECAST_PRODUCT = "PROMO"
GRAPH_PRODUCT = "PROMO"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("top_products")
def _top_products(spark, sf_dir):
    return kpi.top_products(Ctx(spark, sf_dir).lines)


@query("revenue_by_product")
def _revenue_by_product(spark, sf_dir):
    return kpi.revenue_by_product(Ctx(spark, sf_dir).lines)


@query("kpi_sheet")
def _kpi_sheet(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return kpi.kpi_sheet(c.tx, c.periods, c.orders)


@query("period_growth")
def _period_growth(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return kpi.period_growth(c.tx, c.periods)


@query("trending_product")
def _trending_product(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return kpi.trending_product(c.tx, c.periods)


@query("weekday_pattern")
def _weekday_pattern(spark, sf_dir):
    return trends.weekday_pattern(Ctx(spark, sf_dir).orders)


@query("best_day")
def _best_day(spark, sf_dir):
    return trends.best_day(Ctx(spark, sf_dir).orders)


@query("mom_growth")
def _mom_growth(spark, sf_dir):
    return trends.mom_growth(Ctx(spark, sf_dir).orders)


@query("monthly_revenue")
def _monthly_revenue(spark, sf_dir):
    return trends.monthly_revenue(Ctx(spark, sf_dir).orders)


@query("season_top")
def _season_top(spark, sf_dir):
    return seasonal.season_top(Ctx(spark, sf_dir).tx)


@query("peak_month")
def _peak_month(spark, sf_dir):
    return seasonal.peak_month(Ctx(spark, sf_dir).orders)


@query("upcoming_season")
def _upcoming_season(spark, sf_dir):
    return seasonal.upcoming_season(table(spark, sf_dir, "orders"), "o_orderdate")


@query("stock_alert")
def _stock_alert(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return stock.stock_alert(c.tx, c.periods)


@query("rfm")
def _rfm(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return customers.rfm(c.orders, c.as_of)


@query("top_customers")
def _top_customers(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return customers.top_customers(c.orders, c.as_of)


@query("customer_summary")
def _customer_summary(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return customers.customer_summary(c.orders, c.as_of)


@query("profit_by_product")
def _profit_by_product(spark, sf_dir):
    return profit.profit_by_product(Ctx(spark, sf_dir).lines)


@query("top_profitable")
def _top_profitable(spark, sf_dir):
    return profit.top_profitable(Ctx(spark, sf_dir).lines)


@query("profit_summary")
def _profit_summary(spark, sf_dir):
    return profit.profit_summary(Ctx(spark, sf_dir).lines)


@query("best_campaign_day")
def _best_campaign_day(spark, sf_dir):
    return marketing.best_campaign_day(Ctx(spark, sf_dir).orders)


@query("declining_products")
def _declining_products(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return marketing.declining_products(c.tx, c.periods)


@query("campaign_plan")
def _campaign_plan(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return marketing.campaign_plan(c.tx, c.periods)


@query("compare_products")
def _compare_products(spark, sf_dir):
    return compare.compare_products(Ctx(spark, sf_dir).lines, COMPARE_PRODUCTS)


@query("comparison_stats")
def _comparison_stats(spark, sf_dir):
    return compare.comparison_stats(Ctx(spark, sf_dir).lines, COMPARE_PRODUCTS)


@query("export_summary")
def _export_summary(spark, sf_dir):
    return export.export_summary(Ctx(spark, sf_dir).lines)


@query("export_daily")
def _export_daily(spark, sf_dir):
    return export.export_daily(Ctx(spark, sf_dir).tx)


@query("sales_range")
def _sales_range(spark, sf_dir):
    return export.sales_rows(Ctx(spark, sf_dir).tx, RANGE_START, RANGE_END)


# --- sentiment, interest and text -------------------------------------------------


@query("sentiment_mean")
def _sentiment_mean(spark, sf_dir):
    return sentiment.sentiment_mean(adapter.social_sentiment(spark, sf_dir))


@query("sentiment_series")
def _sentiment_series(spark, sf_dir):
    return sentiment.sentiment_series(adapter.social_sentiment(spark, sf_dir))


@query("social_weekly")
def _social_weekly(spark, sf_dir):
    return sentiment.weekly_sentiment(adapter.social_sentiment(spark, sf_dir))


@query("lexicon_sentiment")
def _lexicon_sentiment(spark, sf_dir):
    return sentiment.lexicon_sentiment(table(spark, sf_dir, "documents"))


# A lexicon whose words the documents use: every score band occurs.
DOCUMENT_LEXICON = {"the": 0.5, "and": -0.2, "that": -0.9, "der": 0.4, "und": -0.3, "de": 0.2, "la": -0.6,
                    "les": 0.3, "que": -0.1, "el": 0.7}


@query("lexicon_documents")
def _lexicon_documents(spark, sf_dir):
    return sentiment.lexicon_sentiment(table(spark, sf_dir, "documents"), DOCUMENT_LEXICON)


@query("interest_index")
def _interest_index(spark, sf_dir):
    return sentiment.interest_index(table(spark, sf_dir, "events"))


@query("answer_cleanup")
def _answer_cleanup(spark, sf_dir):
    return text.answer_cleanup(table(spark, sf_dir, "conversations"))


@query("bengali_flag")
def _bengali_flag(spark, sf_dir):
    return text.bengali_flag(table(spark, sf_dir, "documents"))


@query("json_coalesce")
def _json_coalesce(spark, sf_dir):
    return text.json_reply(table(spark, sf_dir, "events"))


@query("date_labels")
def _date_labels(spark, sf_dir):
    return text.date_labels(table(spark, sf_dir, "orders"), "o_orderdate")


# --- forecast, pricing, models ------------------------------------------------------


def _daily(spark, sf_dir):
    """The daily cube."""
    return daily_stats(Ctx(spark, sf_dir).tx)


@query("forecast_daily")
def _forecast_daily(spark, sf_dir):
    return fc.forecast(_daily(spark, sf_dir), grain="day")


@query("forecast_row_grain")
def _forecast_row_grain(spark, sf_dir):
    return fc.forecast(_daily(spark, sf_dir), grain="row")


@query("forecast_mean")
def _forecast_mean(spark, sf_dir):
    return fc.forecast_mean(_daily(spark, sf_dir))


@query("error_by_group")
def _error_by_group(spark, sf_dir):
    return fc.error_by_group(_daily(spark, sf_dir))


@query("price_parity")
def _price_parity(spark, sf_dir):
    return pricing.price_parity(_daily(spark, sf_dir))


@query("price_elastic")
def _price_elastic(spark, sf_dir):
    return pricing.price_elastic(_daily(spark, sf_dir))


@query("price_attribution")
def _price_attribution(spark, sf_dir):
    return pricing.price_attribution(_daily(spark, sf_dir))


@query("regression_fit")
def _regression_fit(spark, sf_dir):
    return pricing.regression_fit(_daily(spark, sf_dir))


@query("popularity")
def _popularity(spark, sf_dir):
    return recommend.popularity(Ctx(spark, sf_dir).lines)


@query("recommend_popular")
def _recommend_popular(spark, sf_dir):
    return recommend.recommend_popular(Ctx(spark, sf_dir).lines)


@query("recommend_als")
def _recommend_als(spark, sf_dir):
    return recommend.recommend_als(Ctx(spark, sf_dir).tx)


# --- graph and vectors ----------------------------------------------------------------

@query("graph_edges")
def _graph_edges(spark, sf_dir):
    return graph.edges(Ctx(spark, sf_dir).tx)


@query("graph_nodes")
def _graph_nodes(spark, sf_dir):
    return graph.nodes(graph.edges(Ctx(spark, sf_dir).tx))


@query("graph_neighbours")
def _graph_neighbours(spark, sf_dir):
    return graph.neighbours(graph.edges(Ctx(spark, sf_dir).tx), GRAPH_PRODUCT)


@query("graph_insights")
def _graph_insights(spark, sf_dir):
    return graph.insights(graph.edges(Ctx(spark, sf_dir).tx))


@query("knn_l2")
def _knn_l2(spark, sf_dir):
    return vectors.knn_label_centroids(table(spark, sf_dir, "embeddings"))


# --- context, catalog, spines ---------------------------------------------------------

@query("dashboard_context")
def _dashboard_context(spark, sf_dir):
    return ctxop.dashboard_context(Ctx(spark, sf_dir).tx, adapter.product_sentiment(spark, sf_dir))


@query("catalog")
def _catalog(spark, sf_dir):
    return catalog_from_parts(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))


@query("date_spine")
def _date_spine(spark, sf_dir):
    return spine.daily_spine(Ctx(spark, sf_dir).tx)


@query("seasonal_index")
def _seasonal_index(spark, sf_dir):
    return spine.seasonal_index(Ctx(spark, sf_dir).tx)


@query("category_distinct")
def _category_distinct(spark, sf_dir):
    return spine.category_distinct(Ctx(spark, sf_dir).lines)


# --- sinks read back ------------------------------------------------------------------

@query("csv_round_trip")
def _csv_round_trip(spark, sf_dir):
    """S4 then S3: the daily sheet written as CSV and scanned back."""
    path = scratch_dir(spark, "daily-csv")
    files.write_csv(export.export_daily(Ctx(spark, sf_dir).tx), path)
    return files.read_csv(spark, path, DAILY_SALES)


@query("append_dedup")
def _append_dedup(spark, sf_dir):
    """The weekly sentiment batch appended twice, the first time with other
    values; on read the newer row of a key counts."""
    path = scratch_dir(spark, "weekly-append")
    batch = sentiment.weekly_sentiment(adapter.social_sentiment(spark, sf_dir))
    files.write_table(batch.withColumn("sentiment", F.lit(0.0)).withColumn("batch_id", F.lit(0)), path, "append")
    files.write_table(batch.withColumn("batch_id", F.lit(1)), path, "append")
    return files.read_dedup(spark, path, ["week", "product"])


@query("records_json")
def _records_json(spark, sf_dir):
    """Revenue per product as JSON records (exact decimal revenue)."""
    agg = Ctx(spark, sf_dir).lines.groupBy("product").agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("n_rows"))
    return export.records_json(agg)


# --- projections and rankings ------------------------------------------------------------
@query("forecast_input")
def _forecast_input(spark, sf_dir):
    return fc.forecast_input(Ctx(spark, sf_dir).tx, FORECAST_PRODUCT)


@query("user_top_products")
def _user_top_products(spark, sf_dir):
    return recommend.user_top_products(Ctx(spark, sf_dir).tx)


@query("product_list")
def _product_list(spark, sf_dir):
    return recommend.product_list(Ctx(spark, sf_dir).lines)


# --- adapter and branches that need their own inputs -----------------------------------------------
@query("orphan_counts")
def _orphan_counts(spark, sf_dir):
    return adapter.orphan_counts(spark, sf_dir)


@query("stock_alert_levels")
def _stock_alert_levels(spark, sf_dir):
    """K2 with stock levels from a table: units sold, scaled by the length of
    the product's name, so that every status band occurs."""
    c = Ctx(spark, sf_dir)
    levels = c.lines.groupBy("product").agg(F.sum("quantity").alias("units")).select(
        "product", F.expr("units * (length(product) - 4) div 400").alias("stock"))
    return stock.stock_alert(c.tx, c.periods, levels)


def _brand_costs(spark, sf_dir):
    """A cost ratio per brand: 0.50 plus 0.01 per brand number."""
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), (F.lit(50) + number).cast("decimal(10,4)").alias("pct")).distinct() \
        .select("brand", (F.col("pct") / 100).cast("decimal(5,4)").alias("cost_ratio"))


@query("profit_brand_costs")
def _profit_brand_costs(spark, sf_dir):
    return profit.profit_by_product(Ctx(spark, sf_dir).lines, _brand_costs(spark, sf_dir))


@query("revenue_by_month")
def _revenue_by_month(spark, sf_dir):
    return seasonal.revenue_by_month_number(Ctx(spark, sf_dir).orders)


@query("forecast_latest")
def _forecast_latest(spark, sf_dir):
    f = fc.forecast_latest(_daily(spark, sf_dir))
    return f.select("product", "ds", rnd(F.col("yhat")).alias("yhat"))


@query("reply_shapes")
def _reply_shapes(spark, sf_dir):
    """F25 over every reply shape, built from the conversations."""
    conv = table(spark, sf_dir, "conversations")
    t = F.col("text")
    case = (F.col("conv_id") + F.col("turn")) % 6
    one = lambda **kw: F.array(F.struct(*[v.alias(k) for k, v in kw.items()]))
    js = (F.when(case == 0, F.to_json(F.struct(one(content=F.lit(""), text=t).alias("candidates"))))
          .when(case == 1, F.to_json(F.struct(one(other=F.lit(1)).alias("candidates"), t.alias("response"))))
          .when(case == 2, F.to_json(F.struct(one(content=t, text=F.lit("no")).alias("output"))))
          .when(case == 3, F.to_json(F.struct(one(text=t).alias("outputs"))))
          .when(case == 4, F.to_json(F.struct(t.alias("response"))))
          .otherwise(F.to_json(F.struct(F.array(F.lit("x")).alias("output"), t.alias("response")))))
    return conv.select("conv_id", "turn", reply_text(js).alias("reply"))


@query("bengali_mixed")
def _bengali_mixed(spark, sf_dir):
    """F23 with both answers: every fifth document ends in a Bengali word."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" \u09a6\u09cb\u0995\u09be\u09a8")))
        .otherwise(F.col("text")))
    return text.bengali_flag(docs)


# --- files written and read back ---------------------------------------------------------------------
@query("sales_ingest")
def _sales_ingest(spark, sf_dir):
    """A reference-shaped CSV (text dates, five columns) written,
    scanned and conformed to the transactions schema."""
    path = scratch_dir(spark, "sales-csv")
    tx = Ctx(spark, sf_dir).tx.select(F.col("dt").cast("string").alias("date"), "product", "quantity",
                                      rnd(F.col("price")).alias("price"), "user_id")
    files.write_csv(tx, path)
    raw = files.read_csv(spark, path, "date string, product string, quantity int, price double, user_id long")
    return adapter.conform_sales(raw).select("dt", "product", "category", "quantity", "price",
                                             rnd(F.col("total_amount")).alias("total_amount"), "user_id")


@query("sales_export")
def _sales_export(spark, sf_dir):
    """The three sheets written and read back; rows and units of each."""
    paths = export.write_sales_export(Ctx(spark, sf_dir).tx, scratch_dir(spark, "sales-export"))
    units = {"sales_data": "quantity", "summary_statistics": "qty_sum", "daily_sales": "quantity"}
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("sheet"), F.count(F.lit(1)).alias("n_rows"),
                                       F.sum(units[n]).alias("units")) for n, p in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("comparison_export")
def _comparison_export(spark, sf_dir):
    """The per-product sheets written and read back."""
    paths = export.write_comparison_export(Ctx(spark, sf_dir).lines, COMPARE_PRODUCTS, scratch_dir(spark, "compare"))
    return spark.read.parquet(paths["products"]).groupBy(F.col("sheet").alias("product")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").alias("units"))


@query("trend_append")
def _trend_append(spark, sf_dir):
    """Interest series appended with a constant source column."""
    path = scratch_dir(spark, "trends")
    files.write_table(files.with_constant(sentiment.interest_index(table(spark, sf_dir, "events")), "source", "trends"),
                      path, "append")
    return spark.read.parquet(path)


@query("regression_multi")
def _regression_multi(spark, sf_dir):
    """M11 with two features: daily units of one product on price and weekday."""
    d = pricing.daily_price_demand(_daily(spark, sf_dir)).where(F.col("product") == FORECAST_PRODUCT) \
        .withColumn("wd", F.weekday("dt").cast("double"))
    m = pricing.fit_linear_model(d, ["p", "wd"], "q")
    return m.select("term", rnd(F.col("coefficient"), 3).alias("coefficient"), rnd(F.col("r2"), 4).alias("r2"), "n")


# --- many-query neighbours, trailing distinct counts, co-purchase ------------------------------------
@query("knn_all")
def _knn_all(spark, sf_dir):
    """The nearest others of every stored vector."""
    return neighbours.nearest_of_all(table(spark, sf_dir, "embeddings"))


@query("customers_trailing")
def _customers_trailing(spark, sf_dir):
    """A3: distinct customers of each product in the 30 days up to each day."""
    return customers_window.customers_trailing(Ctx(spark, sf_dir).tx)


def _part_purchases(spark, sf_dir):
    li, od = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return copurchase.purchases(li.join(od, li.l_orderkey == od.o_orderkey), "l_partkey", "o_custkey")


@query("copurchase_neighbours")
def _copurchase_neighbours(spark, sf_dir):
    """For every part the five most often bought by the same customers."""
    return copurchase.copurchase_neighbours(_part_purchases(spark, sf_dir)).select(
        F.col("item").alias("part"), "rank", F.col("other").alias("neighbour"), "both",
        rnd(F.col("cosine"), 6).alias("cosine"))


@query("copurchase_products")
def _copurchase_products(spark, sf_dir):
    """Every pair of products with common customers."""
    return copurchase.copurchase(copurchase.purchases(Ctx(spark, sf_dir).tx)).select(
        F.col("item").alias("product"), F.col("other").alias("neighbour"), "both",
        rnd(F.col("cosine"), 6).alias("cosine"))


# --- models over all products ------------------------------------------------------------------------
@query("forecast_fourier")
def _forecast_fourier(spark, sf_dir):
    """M1: change points and Fourier seasons, every product in one job."""
    return forecast_fourier.forecast_fourier(_daily(spark, sf_dir))


@query("forecast_backtest")
def _forecast_backtest(spark, sf_dir):
    """Errors out of sample, from every origin."""
    return backtest.rolling_origin_errors(_daily(spark, sf_dir))


@query("regression_products")
def _regression_products(spark, sf_dir):
    """Daily units on price and weekday, fitted for every product."""
    d = pricing.daily_price_demand(_daily(spark, sf_dir))
    sums = least_squares.normal_equations(d, ["product"], {"p": F.col("p"), "wd": F.weekday("dt")}, F.col("q"))
    m = least_squares.solve(sums, ["product"])
    return m.select("product", *[rnd(F.element_at("beta", i + 1), 3).alias(c)
                                 for i, c in enumerate(("intercept", "price", "weekday"))],
                    rnd(F.col("r2"), 4).alias("r2"), "n")


@query("demand_shapley")
def _demand_shapley(spark, sf_dir):
    """Shapley values of price, weekday and month."""
    return shapley.demand_shapley(_daily(spark, sf_dir))


# --- whole sheets, the report's lines, dates and prefixes ---------------------------------------------
@query("sales_sheets")
def _sales_sheets(spark, sf_dir):
    """Every row of the three sheets, written and read back."""
    paths = export.write_sales_export(Ctx(spark, sf_dir).tx, scratch_dir(spark, "sales-sheets"))
    return export.read_sheets(spark, paths)


@query("comparison_sheets")
def _comparison_sheets(spark, sf_dir):
    """Every row of the statistics sheet and of the products' sheets."""
    paths = export.write_comparison_export(Ctx(spark, sf_dir).lines, COMPARE_PRODUCTS, scratch_dir(spark, "compare-sheets"))
    rows = spark.read.parquet(paths["products"]).select(
        F.col("sheet"), "transaction_id", "product", "product_name", "quantity", rnd(F.col("price")).alias("price"),
        F.col("total_amount").cast("double").alias("total_amount"))
    stats = spark.read.parquet(paths["comparison"]).withColumn("sheet", F.lit("comparison"))
    return rows.unionByName(stats, allowMissingColumns=True)


@query("forecast_report")
def _forecast_report(spark, sf_dir):
    """The lines of the text report, written and read back."""
    path = export.write_forecast_report(fc.forecast(_daily(spark, sf_dir)), scratch_dir(spark, "report"))
    return spark.read.text(path).select("product", F.col("value").alias("line"))


@query("day_of_year")
def _day_of_year(spark, sf_dir):
    """orders and revenue by day of the year."""
    return Ctx(spark, sf_dir).orders.groupBy(F.dayofyear("dt").alias("day_of_year")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("total_amount").cast("double").alias("revenue"))


@query("sheet_names")
def _sheet_names(spark, sf_dir):
    """a sheet's name is the product's first 30 characters; names that
    fall together get a number."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("product")).distinct() \
        .withColumn("prefix", F.substring("product", 1, 30))
    same = Window.partitionBy("prefix")
    nth = F.row_number().over(same.orderBy("product"))
    return names.select("product", F.when(F.count(F.lit(1)).over(same) > 1, F.concat_ws("~", "prefix", nth.cast("string")))
                        .otherwise(F.col("prefix")).alias("sheet"))


# --- rules, bad lines, repeated ingestion -------------------------------------------------------------
# Rules whose words the tables use, so that every branch occurs.
TABLE_RULES = sentiment_rules.Rules(lexicon=DOCUMENT_LEXICON, boosters={"of": 0.293, "in": 0.293, "le": -0.293, "en": 0.293},
                                    negations=("to", "is", "die", "un"))


@query("rules_documents")
def _rules_documents(spark, sf_dir):
    """Negations and boosters over whole documents."""
    return sentiment_rules.rule_sentiment(table(spark, sf_dir, "documents"), ["doc_id"], rules=TABLE_RULES)


@query("rules_conversations")
def _rules_conversations(spark, sf_dir):
    return sentiment_rules.rule_sentiment(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], rules=TABLE_RULES)


@query("csv_bad_lines")
def _csv_bad_lines(spark, sf_dir):
    """S3: the daily sheet as text, some lines damaged; accepted rows and rejects."""
    d = export.export_daily(Ctx(spark, sf_dir).tx)
    q = F.col("quantity")
    path = scratch_dir(spark, "bad-lines")
    d.select(F.when(q % 7 == 0, F.concat_ws(",", "dt", "product", "quantity", F.lit("n/a")))
             .when(q % 11 == 0, F.concat_ws(",", "dt", "product"))
             .when(q % 13 == 0, F.concat_ws(",", "dt", "product", "quantity", "price", F.lit("more")))
             .otherwise(F.concat_ws(",", "dt", "product", "quantity", "price"))).write.text(path)
    rows, rejects = files.read_csv_checked(spark, path, DAILY_SALES, scratch_dir(spark, "checked"), header=False)
    return rows.unionByName(rejects.filter("reason = 'fields'").withColumn("line", F.regexp_extract("line", "^[^,]*,[^,]*", 0))
                            .unionByName(rejects.filter("reason = 'value'")), allowMissingColumns=True)


@query("ingest_twice")
def _ingest_twice(spark, sf_dir):
    """Overlapping batches of months, the second one twice; one copy of
    each day."""
    path = scratch_dir(spark, "ingest")
    # The three batches are cut from one copy of the daily sheet.
    daily = scratch_dir(spark, "ingest-daily")
    export.export_daily(Ctx(spark, sf_dir).tx).withColumn("month", F.date_format("dt", "yyyy-MM")).write.parquet(daily)
    d = spark.read.parquet(daily)
    files.ingest_days(d.where("dt < date'1997-01-01'").withColumn(
        "quantity", F.when(F.year("dt") == 1996, F.col("quantity") * 2).otherwise(F.col("quantity"))), path, "month")
    for _ in range(2):
        files.ingest_days(d.where("dt >= date'1996-01-01'"), path, "month")
    return spark.read.parquet(path).select("dt", "product", "quantity", "price")


# --- gaps between groups, quality of recommendations --------------------------------------------------
@query("error_gaps")
def _error_gaps(spark, sf_dir):
    """Errors of each product's forecast against the others', with intervals."""
    return bootstrap.error_gaps(_daily(spark, sf_dir))


@query("order_value_gaps")
def _order_value_gaps(spark, sf_dir):
    """Order values of each customer segment against the others'."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left")
    return bootstrap.group_gaps(rows, F.col("c_mktsegment"), F.col("o_totalprice"), F.col("o_orderkey"))


@query("recommend_quality")
def _recommend_quality(spark, sf_dir):
    """M6, M7: the last order of each user held out; popular and own products."""
    return recommend_quality.compare_lists(Ctx(spark, sf_dir).tx)


@query("recommend_quality_brands")
def _recommend_quality_brands(spark, sf_dir):
    return recommend_quality.compare_lists(Ctx(spark, sf_dir).tx.withColumn("product", F.col("brand")), (1, 5, 10))


@query("recommend_als_quality")
def _recommend_als_quality(spark, sf_dir):
    """M6, M7: ALS by brand, fitted without the held-out orders, and the popular brands."""
    return recommend_quality.als_quality(Ctx(spark, sf_dir).tx.withColumn("product", F.col("brand")), (1, 5, 10))
