"""Every endpoint method runs on sf0.001 and respects its parameters."""

from haat.plans.endpoints import Dashboard
from haat.session import scratch_dir

from tests.conftest import SF_SMALL


def test_endpoints(spark):
    d = Dashboard(spark, SF_SMALL)
    p = "PROMO"
    assert {r["product"] for r in d.forecast(p).collect()} == {p}
    assert d.forecast(p).count() == 30
    assert d.price(p).first()["action"] == 0
    assert d.price_details(p).count() > 0
    recs = d.recommend(user_id=7).collect()
    assert len(recs) == 5 and {r["user_id"] for r in recs} == {7}
    g = d.graph(p)
    assert g["insights"].count() > 3 and g["nodes"].count() > 0 and g["edges"].count() > 0
    assert d.products().count() > 0
    assert d.social("click").count() == 1 and d.social_series("click").count() > 0
    assert d.kpis()["sheet"].count() == 1 and d.kpis()["top_products"].count() == 5
    assert d.stock_alert().count() > 0
    assert d.trends()["weekly_pattern"].count() == 7
    assert d.customer_insights()["summary"].count() == 1
    assert d.profit_analysis()["summary"].count() == 1
    assert d.seasonal_predictor()["upcoming_season"].count() == 1
    assert d.marketing_planner().count() == 1
    assert {r["product"] for r in d.compare("PROMO, STANDARD, nothing").collect()} == {"PROMO", "STANDARD"}
    assert d.chat_context(p).count() == 1
    paths = d.export_excel(scratch_dir(spark, "ep-export"), "1996-01-01", "1996-12-31")
    assert spark.read.parquet(paths["sales_data"]).count() > 0
    assert d.export_forecast(scratch_dir(spark, "ep-report"), p)
