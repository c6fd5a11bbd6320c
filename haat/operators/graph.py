"""Product–user bipartite graph (M8, M9, A25, J7, K11) as two DataFrames:
``edges(product, user, weight, …)`` and ``nodes(id, kind, degree)``.

The reference draws a random user per row; here the user is the buyer.
One edge per (product, user); like ``add_edge`` overwriting the attribute,
the weight is the quantity of the *last* row — last by (date, transaction,
quantity), a full order that includes the value itself because
``(order, line)`` is not unique in the data.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def user_node(user_id):
    return F.concat(F.lit("user_"), user_id.cast("string"))


# The "last row" order (date, transaction, quantity) packed into one
# DECIMAL(38,0) so ``max`` runs in a hash aggregate (a struct-valued
# ``max_by`` forces a sort-based aggregate).  Each part is made non-negative
# and gets its own digit range, so numeric order equals tuple order:
#   days since 0001-01-01 (< 10^6) · 10^31  +  (transaction + 2^63) (< 10^21) · 10^10
#   +  (quantity + 2^31) (< 10^10)
_DAY0 = "0001-01-01"
_TID_OFF, _Q_OFF = 2 ** 63, 2 ** 31


def _dec(v):
    return F.lit(Decimal(v)).cast("decimal(38,0)")


def _last_key(dt, tid, q):
    d = F.datediff(dt, F.lit(_DAY0).cast("date")).cast("decimal(38,0)")
    return (d * _dec(10 ** 31) + (tid.cast("decimal(38,0)") + _dec(_TID_OFF)) * _dec(10 ** 10)
            + (q.cast("decimal(38,0)") + _dec(_Q_OFF))).cast("decimal(38,0)")


def _key_quantity(key):
    return (key % _dec(10 ** 10) - _dec(_Q_OFF)).cast("int")


def edges(tx: DataFrame) -> DataFrame:
    """Last-wins weight plus the summed units and line count.  A hot
    product only means many (product, user) groups; each group combines
    map-side in a hash aggregate, so no group is collected or sorted."""
    key = _last_key(F.col("dt"), F.col("transaction_id"), F.col("quantity"))
    return tx.groupBy("product", "user_id").agg(
        F.max(key).alias("last_key"),
        F.sum("quantity").alias("total_quantity"),
        F.count(F.lit(1)).alias("n_lines"),
    ).select("product", user_node(F.col("user_id")).alias("user"),
             _key_quantity(F.col("last_key")).alias("weight"), "total_quantity", "n_lines")


def nodes(e: DataFrame) -> DataFrame:
    """M8: every product and user node with its degree."""
    p = e.groupBy(F.col("product").alias("id")).agg(F.count(F.lit(1)).alias("degree")) \
        .withColumn("kind", F.lit("product"))
    u = e.groupBy(F.col("user").alias("id")).agg(F.count(F.lit(1)).alias("degree")) \
        .withColumn("kind", F.lit("user"))
    return p.unionByName(u).select("id", "kind", "degree")


def neighbours(e: DataFrame, product: str) -> DataFrame:
    """All neighbours of one product node (one row each)."""
    return e.where(F.col("product") == product).select(
        "product", F.col("user").alias("neighbour"), "weight")


def summary(e: DataFrame) -> DataFrame:
    """Per product: number of neighbours and units they bought."""
    return e.groupBy("product").agg(F.count(F.lit(1)).alias("degree"), F.sum("total_quantity").alias("units"))


def insights(e: DataFrame) -> DataFrame:
    """M9: every neighbour of every product, one row each, with the product's
    degree and units.  The summary has one row per product and combines
    map-side; a hot product's edges are split by the skew join."""
    return e.join(summary(e), "product").select(
        "product", F.col("user").alias("neighbour"), "weight", "degree", "units")


def insight_text(e: DataFrame) -> DataFrame:
    """M9 as one line per product, with counts in place of the list."""
    return summary(e).select("product", F.concat(
        F.lit("Related to: "), F.col("degree").cast("string"), F.lit(" customers, "),
        F.col("units").cast("string"), F.lit(" units")).alias("insight"))
