"""Bucketed facts join without a shuffle; the month-partitioned fact table
gives the same answers and prunes months."""

import re

from haat.functions.periods import Periods
from haat.operators import kpi, stock
from haat.session import scratch_dir
from haat.sources import adapter, layout

from tests.conftest import SF_SMALL


def test_bucketed_join_has_no_exchange_below_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        li, od = layout.write_bucketed_facts(spark, SF_SMALL, 4, prefix="t_bucket")
        tx = layout.transactions_bucketed(spark, SF_SMALL, li, od)
        df = tx.groupBy("transaction_id").count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the order-key join reads both sides by bucket: the only exchanges
        # left are the part join's and none is on the order key
        assert not re.search(r"Exchange hashpartitioning\((l|o)_orderkey", plan), plan
        ref = adapter.transactions(spark, SF_SMALL).groupBy("transaction_id").count()
        assert sorted(df.collect()) == sorted(ref.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_month_partitioned_fact_table(spark):
    tx = adapter.transactions(spark, SF_SMALL)
    path = layout.write_fact_table(tx, scratch_dir(spark, "fact"))
    ft = layout.read_fact_table(spark, path)
    as_of = adapter.resolve_as_of(spark, SF_SMALL)
    sa = stock.stock_alert(ft, Periods(as_of))
    plan = sa._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan), plan
    a = sorted(map(tuple, sa.collect()))
    b = sorted(map(tuple, stock.stock_alert(tx, Periods(as_of)).collect()))
    assert a == b
    assert sorted(map(tuple, kpi.revenue_by_product(ft).collect())) == \
        sorted(map(tuple, kpi.revenue_by_product(tx).collect()))
