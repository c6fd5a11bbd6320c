"""Sources and sinks: CSV round trip and fallback, reference-shaped input,
export writers, literal catalog, JSON records, append + dedup."""

import json
import os

from pyspark.sql import functions as F

from haat.operators import export, forecast, kpi
from haat.schemas import CATALOG, DAILY_SALES
from haat.session import scratch_dir
from haat.sources import adapter, files


def test_csv_fallback_when_missing(spark, fixture_tx):
    missing = scratch_dir(spark, "nope")
    fb = export.export_daily(fixture_tx)
    assert files.read_csv(spark, missing, DAILY_SALES, fallback=fb) is fb
    path = files.write_csv(fb, scratch_dir(spark, "daily"))
    back = files.read_csv(spark, path, DAILY_SALES, fallback=None)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fb.collect()))


def test_conform_reference_layout(spark):
    small = spark.createDataFrame(
        [("2026-01-15", "clothing", 2, 100.0, 1), ("2026-01-12", "food", 1, 50.5, 2)],
        "date string, product string, quantity int, price double, user_id int")
    tx = adapter.conform_sales(small)
    assert tx.schema.fieldNames() == [f.name for f in
                                      __import__("haat.schemas", fromlist=["x"]).TRANSACTIONS.fields]
    rev = {r["product"]: r["revenue"] for r in kpi.revenue_by_product(tx).collect()}
    assert rev == {"clothing": 200.0, "food": 50.5}
    four = spark.createDataFrame([("2026-01-15", "toys", 3, 30.0)],
                                 "date string, product string, quantity int, price double")
    r = adapter.conform_sales(four).first()
    assert r["user_id"] is None and r["transaction_id"] is not None


def test_sales_export_writes_three_sheets(spark, fixture_tx):
    out = scratch_dir(spark, "export")
    paths = export.write_sales_export(fixture_tx, out, "2025-11-01", "2026-01-31")
    assert spark.read.parquet(paths["sales_data"]).count() == 9
    summ = {r["product"]: r for r in spark.read.parquet(paths["summary_statistics"]).collect()}
    assert summ["toys"]["qty_sum"] == 6 and summ["toys"]["qty_count"] == 3
    assert spark.read.parquet(paths["daily_sales"]).count() == 9


def test_forecast_report_and_comparison_export(spark, fixture_tx):
    fc = forecast.forecast(fixture_tx, horizon=5, min_rows=1)
    out = export.write_forecast_report(fc, scratch_dir(spark, "report"))
    local = out[len("file:"):] if out.startswith("file:") else out
    prods = sorted(d for d in os.listdir(local) if d.startswith("product="))
    assert prods  # one folder per product
    lines = spark.read.text(os.path.join(out, prods[0])).collect()
    assert lines[0]["value"].startswith("=== Demand Forecast Report ===")
    paths = export.write_comparison_export(fixture_tx, ["food", "toys"], scratch_dir(spark, "cmp"))
    assert spark.read.parquet(paths["comparison"]).count() == 2
    assert spark.read.parquet(paths["products"]).select("sheet").distinct().count() == 2


def test_records_json(spark, fixture_tx):
    recs = export.records_json(kpi.revenue_by_product(fixture_tx)).collect()
    parsed = {json.loads(r["record"])["product"]: json.loads(r["record"]) for r in recs}
    assert parsed["food"] == {"product": "food", "revenue": 660.0, "n_rows": 3}


def test_append_twice_then_dedup(spark, fixture_tx):
    path = scratch_dir(spark, "append")
    batch = export.export_daily(fixture_tx)
    old = batch.withColumn("price", F.lit(-1.0))
    for i, rows in enumerate((old, batch)):
        files.write_table(rows.withColumn("batch_id", F.lit(i)), path, "append")
    assert spark.read.parquet(path).count() == 2 * batch.count()
    newest = files.read_dedup(spark, path, ["dt", "product"])
    assert sorted(newest.select(batch.columns).collect()) == sorted(batch.collect())
    tagged = files.with_constant(batch, "source", "trends")
    assert tagged.select(F.countDistinct("source")).first()[0] == 1


def test_as_of_memo_follows_the_files(spark, tmp_path):
    import shutil
    from tests.conftest import SF_SMALL
    d = tmp_path / "sf"
    d.mkdir()
    for t in ("orders", "lineitem"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", d / f"{t}.parquet")
    first = adapter.resolve_as_of(spark, str(d))
    assert adapter.resolve_as_of(spark, str(d)) == first
    # replace the orders with a table whose newest date is earlier
    od = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    older = od.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    tmp_dir = str(tmp_path / "older")
    older.coalesce(1).write.parquet(tmp_dir)
    (d / "orders.parquet").unlink()
    shutil.copytree(tmp_dir, d / "orders.parquet")
    assert adapter.resolve_as_of(spark, str(d)) < first
