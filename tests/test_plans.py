"""Plan-shape checks for scale: no all-pairs joins, no Python UDFs, bounded
top-k, filters pushed into the scan, model steps reading the daily cube."""

import re

import pytest

from haat.plans.registry import QUERIES as REGISTERED

from tests.conftest import SF_SMALL

EAGER = {"csv_round_trip", "append_dedup", "recommend_als", "recommend_als_quality", "sales_ingest", "sales_export", "comparison_export",
         "trend_append", "regression_multi", "knn_all", "copurchase_neighbours", "copurchase_products",
         "sales_sheets", "comparison_sheets", "forecast_report", "csv_bad_lines", "ingest_twice"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = REGISTERED
    return {n: _plan(qs[n](spark, SF_SMALL)) for n in sorted(qs) if n not in EAGER}


def test_no_all_pairs_join_or_python(plans):
    for name, plan in plans.items():
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in plan, f"{name} uses {bad}"
        assert "FlatMapGroupsInPandas" not in plan, name


@pytest.mark.parametrize("name", ["knn_l2", "season_top", "user_top_products"])
def test_topk_uses_partial_group_limit(plans, name):
    assert len(re.findall(r"WindowGroupLimit", plans[name])) >= 2, plans[name]


@pytest.mark.parametrize("name", ["forecast_daily", "forecast_row_grain", "error_by_group",
                                  "price_elastic", "regression_fit"])
def test_models_scan_the_facts_once(plans, name):
    """One scan, or repeated ones that share an exchange."""
    initial = plans[name]
    assert initial.count("lineitem.parquet") <= 2, initial


def test_lexicon_needs_no_exchange(plans):
    assert "Exchange" not in plans["lexicon_sentiment"] and "Join" not in plans["lexicon_sentiment"]


def test_period_filter_pushed_to_scan(spark):
    from haat.plans.registry import QUERIES
    plan = _plan(QUERIES["stock_alert"](spark, SF_SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan(OrEqual)?\(o_orderdate", plan), plan


def test_scan_prunes_columns(spark):
    from haat.plans.registry import QUERIES
    plan = _plan(QUERIES["top_products"](spark, SF_SMALL))
    m = re.search(r"lineitem\.parquet\].*?ReadSchema: struct<([^>]*)>", plan)
    assert m and "l_shipdate" not in m.group(1) and "l_returnflag" not in m.group(1)


@pytest.mark.parametrize("name", ["revenue_by_product", "profit_by_product", "popularity",
                                  "graph_edges", "rfm", "category_distinct", "sentiment_mean"])
def test_hot_keys_are_pre_aggregated_before_the_shuffle(plans, name):
    """A key holding a third of all rows costs one row per task: every
    grouped query combines map-side (``partial_*``) below its exchange."""
    plan = plans[name]
    assert re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan), plan
    # the map-side aggregate sits directly under the shuffle it feeds
    assert re.search(r"Exchange hashpartitioning\([^\n]*\n[^\n]*HashAggregate\([^\n]*partial_", plan), plan
