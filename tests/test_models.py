"""Model maths: the daily-cube (weighted sums) fit equals the direct
row-level computation; lexicon scoring; graph and recommender shapes."""

import math

import pytest
from pyspark.sql import functions as F

from haat.operators import forecast, graph, recommend, sentiment
from haat.operators.daily import daily_stats
from haat.sources import adapter

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def tx(spark):
    df = adapter.transactions(spark, SF_SMALL).cache()
    yield df
    df.unpersist()          # later plan tests must see the Parquet scans again


def _close(a, b, rel=1e-9):
    return a is not None and b is not None and abs(a - b) <= rel * max(1.0, abs(a), abs(b))


@pytest.mark.parametrize("grain", ["day", "row"])
def test_cube_fit_equals_direct_regression(tx, grain):
    m = forecast.fit(daily_stats(tx), grain)
    got = {r["product"]: (r["a"], r["b"]) for r in m["trend"].collect()}
    if grain == "row":
        obs = tx.select("product", F.col("quantity").cast("double").alias("y"), "dt")
    else:
        obs = tx.groupBy("product", "dt").agg(F.sum("quantity").cast("double").alias("y"))
    obs = obs.withColumn("t", F.datediff("dt", F.lit(forecast.ORIGIN)).cast("double"))
    exp = {r["product"]: (r["a"], r["b"]) for r in obs.groupBy("product").agg(
        F.regr_intercept("y", "t").alias("a"), F.regr_slope("y", "t").alias("b")).collect()}
    assert set(got) == set(exp)
    for p in exp:
        assert _close(got[p][0], exp[p][0], 1e-7) and _close(got[p][1], exp[p][1], 1e-7)


def test_row_grain_sigma_equals_raw_residual_std(tx):
    m = forecast.fit(daily_stats(tx), "row")
    fitted = (m["trend"].select("product", "a", "b")
              .join(m["weekday"], "product").join(m["month"], "product"))
    raw = tx.select("product", F.col("quantity").cast("double").alias("y"),
                    F.datediff("dt", F.lit(forecast.ORIGIN)).cast("double").alias("t"),
                    F.weekday("dt").alias("wd"), F.month("dt").alias("mo"))
    r = raw.join(fitted, ["product", "wd", "mo"]).select(
        "product", (F.col("y") - (F.col("a") + F.col("b") * F.col("t") + F.col("w_eff")
                                  + F.col("m_eff"))).alias("r"))
    exp = {x["product"]: x["s"] for x in r.groupBy("product").agg(F.stddev_samp("r").alias("s")).collect()}
    got = {x["product"]: x["sigma"] for x in m["sigma"].collect()}
    for p in exp:
        assert _close(got[p], exp[p], 1e-6)


def test_lexicon_scoring(spark):
    docs = spark.createDataFrame([(1, "Great product, LOVE it!"), (2, "terrible; slow."),
                                  (3, ""), (4, "nothing here")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in sentiment.lexicon_sentiment(docs).collect()}
    s = 3.1 + 3.2
    assert out[1]["n_tokens"] == 4 and out[1]["n_hits"] == 2 and out[1]["score"] == round(s, 4)
    assert out[1]["compound"] == round(s / math.sqrt(s * s + 15), 4)
    assert out[2]["compound"] < 0 and out[2]["sentiment"] == 0.35
    assert out[3]["n_tokens"] == 0 and out[3]["compound"] == 0.0
    assert out[4]["n_hits"] == 0


def test_graph_shapes(fixture_tx):
    e = graph.edges(fixture_tx)
    # clothing-1, clothing-2, food-1, food-3, toys-1, toys-4, cosmetics-4
    assert e.count() == 7
    nodes = {(r["id"], r["kind"]): r["degree"] for r in graph.nodes(e).collect()}
    assert nodes[("toys", "product")] == 2 and nodes[("user_4", "user")] == 2
    ins = graph.insights(e).collect()
    assert len(ins) == 7 and {(r["neighbour"], r["degree"]) for r in ins if r["product"] == "food"} == {("user_1", 2), ("user_3", 2)}
    text = {r["product"]: r["insight"] for r in graph.insight_text(e).collect()}
    assert text["toys"].startswith("Related to: 2 customers, ")


def test_als_takes_ids_of_any_size(spark):
    rows = [(2 ** 40 + u, f"p{p}", 1 + (u * p) % 3) for u in range(12) for p in range(4) if (u + p) % 3]
    tx = spark.createDataFrame(rows, "user_id long, product string, quantity int")
    got = recommend.recommend_als(tx, n=2, rank=2, max_iter=2, blocks=2).collect()
    assert {r["user_id"] for r in got} == {r[0] for r in rows} and {r["rank"] for r in got} == {1, 2}


def test_knn_takes_any_number_of_queries(spark):
    from haat.operators.vectors import knn_l2
    emb = spark.range(40).selectExpr("id AS vec_id", "array(cast(id AS float), 0f) AS embedding")
    queries = spark.range(5000).selectExpr("id AS qid", "array(cast(id % 40 AS double), 0d) AS vec")
    got = knn_l2(emb, queries, k=1, blocks=8)
    assert got.count() == 5000 and got.where("vec_id <> qid % 40 or distance <> 0").count() == 0


def test_knn_is_the_same_with_and_without_broadcast(spark):
    import random
    from haat.operators.vectors import knn_l2
    rng = random.Random(3)
    point = lambda: [float(rng.randint(-3, 3)) for _ in range(3)]      # noqa: E731
    vectors, asked = {i: point() for i in range(300)}, {q: point() for q in range(25)}
    emb = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    queries = spark.createDataFrame(list(asked.items()), "qid long, vec array<double>")
    want = {(q, r, i) for q, v in asked.items() for r, (_, i) in enumerate(
        sorted((math.dist(v, x), i) for i, x in vectors.items())[:4], 1)}
    for bound, joined in ((1 << 20, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        got = knn_l2(emb, queries, 4, broadcast_bytes=bound)
        assert {(r.qid, r["rank"], r.vec_id) for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and (joined in plan or bound == 0)
    none = queries.limit(0)
    assert knn_l2(emb, none, 4).count() == 0 and knn_l2(emb.limit(0), queries, 4).count() == 0


def test_user_top_products(fixture_tx):
    rows = recommend.user_top_products(fixture_tx, 1).collect()
    top = {r["user_id"]: (r["product"], r["score"]) for r in rows}
    assert top[4] == ("cosmetics", 6) and top[2] == ("clothing", 6)


def test_ml_linear_model_matches_single_feature_slope(tx):
    from haat.operators.pricing import daily_price_demand, fit_linear_model
    d = daily_price_demand(tx).where(F.col("product") == "PROMO")
    got = {r["term"]: r["coefficient"] for r in fit_linear_model(d, ["p"], "q").collect()}
    exp = d.agg(F.regr_slope("q", "p").alias("b"), F.regr_intercept("q", "p").alias("a")).first()
    assert _close(got["p"], exp["b"], 1e-6) and _close(got["intercept"], exp["a"], 1e-6)
    two = fit_linear_model(d.withColumn("p2", F.col("p") * F.col("p")), ["p", "p2"], "q")
    assert {r["term"] for r in two.collect()} == {"intercept", "p", "p2"}

