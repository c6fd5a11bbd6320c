"""How good recommendations are (M6, M7): each user's last order is held out,
lists are made from the orders before it, and ranking measures say how much of
the held-out order they would have named.

An order is held out whole, by time, so nothing of it is learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haat.functions.numeric import rnd
from haat.operators.recommend import _written, recommend_als, recommend_popular, user_top_products

KS = (1, 2, 3)


def holdout(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test).  Test is (user_id, product), the distinct products of the
    last order (by day, then transaction) of each user with two orders or
    more; train is every other row.  Rows without user, product or day are in
    neither.

    The last order is a maximum with map-side combination, and both sides are
    told apart by joins on (user, transaction), so a user with a third of all
    rows makes no large group.
    """
    known = tx.select("user_id", "product", "dt", "transaction_id", "quantity").dropna(
        subset=["user_id", "product", "dt", "transaction_id"])
    order = F.struct("dt", "transaction_id")
    last = known.groupBy("user_id").agg(F.max(order).alias("last"), F.min(order).alias("first")) \
        .filter("last.transaction_id <> first.transaction_id") \
        .select("user_id", F.col("last.transaction_id").alias("transaction_id"))
    on = ["user_id", "transaction_id"]
    return known.join(last, on, "left_anti"), known.join(last, on, "left_semi").select("user_id", "product").distinct()


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def quality(lists: DataFrame, test: DataFrame, ks: tuple = KS) -> DataFrame:
    """Per k: n_users (with a held-out order), n_hits, recall@k and NDCG@k,
    means over the users.

    ``lists`` has rank (from 1) and product, and user_id unless all users get
    the same list.  A user without a list has no hits.  NDCG has gain 1 for a
    product of the held-out order, 0 for others, and is divided by the best
    possible for as many products as the order has.
    """
    on = ["user_id", "product"] if "user_id" in lists.columns else ["product"]
    top = lists.filter(F.col("rank") <= max(ks)).select(*on, "rank")
    found = test.join(top, on, "left").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("wanted"),
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits{k}") for k in ks],
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, _gain(F.col("rank")))), F.lit(0.0)).alias(f"dcg{k}") for k in ks])

    def best(k: int) -> Column:
        return sum((F.when(F.col("wanted") >= i, _gain(F.lit(i))).otherwise(0.0) for i in range(1, k + 1)), F.lit(0.0))

    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits{k}").alias("hits"),
                              (F.col(f"hits{k}") / F.col("wanted")).alias("recall"),
                              (F.col(f"dcg{k}") / best(k)).alias("ndcg")) for k in ks])
    return found.select(F.explode(each).alias("x")).groupBy(F.col("x.k").alias("k")).agg(
        F.count(F.lit(1)).alias("n_users"), F.sum("x.hits").alias("n_hits"),
        rnd(F.avg("x.recall"), 4).alias("recall"), rnd(F.avg("x.ndcg"), 4).alias("ndcg"))


def compare_lists(tx: DataFrame, ks: tuple = KS) -> DataFrame:
    """The popular products against each user's own most bought ones."""
    train, test = holdout(tx)
    models = {"popular": recommend_popular(train, max(ks)), "history": user_top_products(train, max(ks))}
    popular, history = (quality(lists, test, ks).select(F.lit(name).alias("model"), "*") for name, lists in models.items())
    return popular.union(history)


def als_quality(tx: DataFrame, ks: tuple = KS, **als) -> DataFrame:
    """ALS (``recommend_als`` and its parameters), fitted to the training rows
    only, against the popular products.  Both sides are written once."""
    rows = tx.select("user_id", "product", "dt", "transaction_id", "quantity")
    train, test = (_written(df, name) for df, name in zip(holdout(_written(rows, "rows")), ("train", "test")))
    lists = {"als": recommend_als(train, max(ks), **als), "popular": recommend_popular(train, max(ks))}
    personal, popular = (quality(found, test, ks).select(F.lit(name).alias("model"), "*") for name, found in lists.items())
    return personal.union(popular)
