"""Recommenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haat.session import scratch_dir


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def popularity(tx_or_daily: DataFrame) -> DataFrame:
    """Rows per product (``value_counts``)."""
    if "n_rows" in tx_or_daily.columns:
        return tx_or_daily.groupBy("product").agg(F.sum("n_rows").alias("n"))
    return tx_or_daily.groupBy("product").agg(F.count(F.lit(1)).alias("n"))


def recommend_popular(tx: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent products, ties by name.  The reference's
    popularity fallback gives every user this same list."""
    w = Window.orderBy(F.col("n").desc(), F.col("product").asc())
    top = popularity(tx).orderBy(F.col("n").desc(), F.col("product").asc()).limit(n)
    return top.select(F.row_number().over(w).alias("rank"), "product",
                      F.col("n").alias("score"))


def dense_ids(df: DataFrame, col: str, out: str, buckets: int = 1024) -> DataFrame:
    """The distinct values of ``col`` with a dense 0-based int ``out``: numbered
    inside hash buckets, each bucket shifted by the sizes of those before it
    (``buckets`` rows), so no task sees all values."""
    vals = df.select(col).distinct().withColumn("_b", F.pmod(F.xxhash64(col), F.lit(buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = vals.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(col))
    return vals.withColumn("_r", local).join(shift, "_b").select(
        col, (F.col("_off") + F.col("_r") - 1).cast("int").alias(out))


def recommend_als(tx: DataFrame, n: int = 5, rank: int = 8, max_iter: int = 10,
                  reg: float = 0.1, seed: int = 42, blocks: int = 10) -> DataFrame:
    """M6/M7: implicit-feedback ALS on real (user, product, units) and the
    top-n products per user (``recommendForAllUsers``).

    The reference trains on random users and ratings; here the ratings are
    the units each user bought of each product.  Users and
    products get dense int ids by distributed numbering, so ids may have any
    size.  ``blocks`` is a parameter, not a property of the cluster, so that
    results do not depend on where the job runs.  The ratings and the ids are
    written once: numbering, fitting and naming read them again and again.
    """
    from pyspark.ml.recommendation import ALS

    ratings = _written(tx.groupBy("user_id", "product").agg(F.sum("quantity").cast("float").alias("units")), "ratings")
    items = _written(dense_ids(ratings, "product", "item"), "rated-items")
    users = _written(dense_ids(ratings, "user_id", "user"), "rating-users")
    data = ratings.join(items, "product").join(users, "user_id").select("user", "item", "units")
    als = ALS(userCol="user", itemCol="item", ratingCol="units", implicitPrefs=True, rank=rank,
              maxIter=max_iter, regParam=reg, seed=seed, coldStartStrategy="drop",
              numUserBlocks=blocks, numItemBlocks=blocks)
    model = als.fit(data)
    recs = model.recommendForAllUsers(n).select(
        "user", F.posexplode("recommendations").alias("pos", "rec")).join(users, "user")
    return recs.join(items, recs.rec.item == items.item).select(
        "user_id", (F.col("pos") + 1).alias("rank"), "product",
        F.col("rec.rating").alias("score"))


def user_top_products(tx: DataFrame, n: int = 3) -> DataFrame:
    """Per user, the n products bought in the largest quantity (ties by
    name).  The window sees one row per (user, product) — at most the number
    of products per user — and the ``rank <= n`` filter is applied as a
    per-task group limit before the shuffle."""
    scores = tx.groupBy("user_id", "product").agg(F.sum("quantity").alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("product").asc())
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("user_id", "rank", "product", "score"))


def product_list(tx: DataFrame) -> DataFrame:
    """The distinct products (first-seen order is not defined on a
    distributed table, so by name)."""
    return tx.select("product").distinct().orderBy("product")
