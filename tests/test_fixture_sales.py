"""Hand-computed expectations of the micro-fixture (FIXTURES.md §3)."""

from haat.operators import (compare, customers, kpi, marketing, profit, recommend, seasonal,
                            stock, trends)

from tests.conftest import AS_OF


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_kpi_sheet(fixture_tx, periods):
    r = rows(kpi.kpi_sheet(fixture_tx, periods))[0]
    assert r["total_revenue"] == 1740.00
    assert r["total_orders"] == 10
    assert r["unique_customers"] == 4
    assert r["growth_rate"] == -36.08
    assert (r["today_revenue"], r["week_revenue"], r["month_revenue"]) == (250.0, 370.0, 530.0)
    assert r["avg_order_value"] == 193.33
    assert (r["trending_product"], r["trending_growth"]) == ("toys", 28.57)


def test_period_windows(fixture_tx, periods):
    g = {r["product"]: r for r in rows(kpi.period_growth(fixture_tx, periods))}
    assert sum(r["last30_revenue"] for r in g.values()) == 620.0
    assert sum(r["prev30_revenue"] for r in g.values()) == 970.0
    assert g["clothing"]["growth_pct"] == -28.89
    assert g["food"]["growth_pct"] == -53.33
    assert g["cosmetics"]["growth_pct"] is None


def test_revenue_by_product_and_top(fixture_tx):
    rev = {r["product"]: r["revenue"] for r in rows(kpi.revenue_by_product(fixture_tx))}
    assert rev == {"clothing": 770.0, "food": 660.0, "toys": 190.0, "cosmetics": 120.0}
    top = [r["product"] for r in kpi.top_products(fixture_tx, 3).collect()]
    assert top == ["clothing", "food", "toys"]


def test_stock_alert(fixture_tx, periods):
    s = {r["product"]: r for r in rows(stock.stock_alert(fixture_tx, periods))}
    assert set(s) == {"toys", "food", "clothing"}
    exp = {"toys": (3.0, 33, 21), "food": (2.5, 40, 17), "clothing": (1.5, 66, 10)}
    for p, (mean, days, reorder) in exp.items():
        assert (s[p]["daily_avg_sales"], s[p]["days_until_stockout"], s[p]["reorder_point"]) == (mean, days, reorder)
        assert s[p]["status"] == "ok"


def test_stock_bands(fixture_tx, periods):
    # stock 30: toys int(30/3.0)=10 → warning, food int(30/2.5)=12 → warning,
    # clothing int(30/1.5)=20 → ok; stock 10: toys int(3.33)=3 → critical.
    s = {r["product"]: r for r in rows(stock.stock_alert(fixture_tx, periods, current_stock=30))}
    assert [s[p]["status"] for p in ("toys", "food", "clothing")] == ["warning", "warning", "ok"]
    assert s["toys"]["recommendation"].endswith(" ইউনিট") and s["clothing"]["badge"] == "ভালো"
    s = {r["product"]: r for r in rows(stock.stock_alert(fixture_tx, periods, current_stock=10))}
    assert (s["toys"]["days_until_stockout"], s["toys"]["status"]) == (3, "critical")


def test_weekday_pattern(fixture_tx):
    wp = {r["day"]: r["revenue"] for r in rows(trends.weekday_pattern(fixture_tx))}
    assert wp == {"Monday": 190.0, "Tuesday": 450.0, "Wednesday": 90.0, "Thursday": 820.0,
                  "Friday": 160.0, "Saturday": 0.0, "Sunday": 30.0}
    best = rows(trends.best_day(fixture_tx))[0]
    assert (best["day"], best["revenue"]) == ("Thursday", 820.0)


def test_mom_and_peak(fixture_tx):
    m = rows(trends.mom_growth(fixture_tx))[0]
    assert (m["latest_revenue"], m["prev_revenue"], m["mom_growth"]) == (530.0, 540.0, -1.85)
    pk = rows(seasonal.peak_month(fixture_tx))[0]
    assert (pk["month"], pk["revenue"]) == (11, 550.0)


def test_season_top(fixture_tx):
    st = [(r["season"], r["rank"], r["product"], r["revenue"]) for r in rows(seasonal.season_top(fixture_tx))]
    assert sorted(st) == [("eid", 1, "cosmetics", 120.0), ("winter", 1, "clothing", 770.0),
                          ("winter", 2, "food", 660.0), ("winter", 3, "toys", 190.0)]


def test_rfm_and_summary(fixture_tx):
    r = {x["user_id"]: (x["recency"], x["frequency"], x["monetary"])
         for x in rows(customers.rfm(fixture_tx, AS_OF))}
    assert r == {3: (13, 2, 610.0), 2: (3, 2, 570.0), 1: (0, 3, 340.0), 4: (59, 3, 220.0)}
    s = rows(customers.customer_summary(fixture_tx, AS_OF))[0]
    assert (s["total_customers"], s["avg_ltv"], s["at_risk_customers"]) == (4, 435.0, 0)
    top = [x["customer_id"] for x in customers.top_customers(fixture_tx, AS_OF, 2).collect()]
    assert top == [3, 2]


def test_profit(fixture_tx):
    s = rows(profit.profit_summary(fixture_tx))[0]
    assert (s["total_profit"], s["profit_margin"]) == (522.0, 30.0)
    assert s["best_margin"] == 30.0 and s["best_margin_product"] == "clothing"
    assert {r["margin"] for r in rows(profit.profit_by_product(fixture_tx))} == {30.0}


def test_marketing(fixture_tx, periods):
    b = rows(marketing.best_campaign_day(fixture_tx))[0]
    assert (b["day_num"], b["mean_revenue"]) == (1, 450.0)
    d = [(r["product"], r["decline"]) for r in rows(marketing.declining_products(fixture_tx, periods))]
    assert d == [("cosmetics", 100.0), ("food", 53.33), ("clothing", 28.89)]
    plan = rows(marketing.campaign_plan(fixture_tx, periods))[0]
    assert plan["discount_recommendations"] == ["cosmetics", "food", "clothing"]
    assert "cosmetics, food" in plan["recommendation"]


def test_popularity(fixture_tx):
    p = {r["product"]: r["n"] for r in rows(recommend.popularity(fixture_tx))}
    assert p == {"clothing": 3, "food": 3, "toys": 3, "cosmetics": 1}
    top = [(r["rank"], r["product"]) for r in recommend.recommend_popular(fixture_tx, 2).collect()]
    assert top == [(1, "clothing"), (2, "food")]


def test_compare(fixture_tx):
    c = {r["product"]: r for r in rows(compare.compare_products(fixture_tx, "food, toys, nothing"))}
    assert set(c) == {"food", "toys"}
    assert c["food"]["total_sales"] == 15 and c["food"]["transaction_count"] == 3
    assert c["food"]["avg_price"] == 45.0 and c["food"]["avg_quantity"] == 5.0
    st = {r["product"]: r for r in rows(compare.comparison_stats(fixture_tx, ["cosmetics", "toys"]))}
    assert st["cosmetics"]["qty_std"] is None          # one row: sample std undefined
    assert st["toys"]["qty_std"] == 1.0


def test_explicit_earlier_as_of_ignores_later_rows(fixture_tx):
    import datetime as dt
    from haat.functions.periods import Periods
    p = Periods(dt.date(2026, 1, 12))      # Monday; the 2026-01-15 order is "in the future"
    r = rows(kpi.kpi_sheet(fixture_tx, p))[0]
    assert r["today_revenue"] == 120.0      # only transaction 2
    assert r["week_revenue"] == 120.0
    assert r["month_revenue"] == 280.0      # 120 + 160 (2026-01-02)


def test_stock_and_cost_tables(spark, fixture_tx, periods):
    levels = spark.createDataFrame([("toys", 30), ("food", 300)], "product string, stock int")
    s = {r["product"]: r for r in rows(stock.stock_alert(fixture_tx, periods, levels))}
    assert (s["toys"]["current_stock"], s["toys"]["status"]) == (30, "warning")      # int(30/3.0) = 10
    assert (s["food"]["current_stock"], s["food"]["days_until_stockout"]) == (300, 120)
    assert s["clothing"]["current_stock"] == 100                                       # default
    costs = spark.createDataFrame([("toys", 0.5), ("food", 0.9)], "product string, cost_ratio double")
    m = {r["product"]: r["margin"] for r in rows(profit.profit_by_product(fixture_tx, costs))}
    assert m == {"toys": 50.0, "food": 10.0, "clothing": 30.0, "cosmetics": 30.0}
    best = rows(profit.profit_summary(fixture_tx, costs))[0]
    assert best["best_margin_product"] == "toys"
    # 770*0.3 + 660*0.1 + 190*0.5 + 120*0.3 = 231 + 66 + 95 + 36
    assert best["total_profit"] == 428.0
