"""Adapter from the driver's star schema to the logical retail tables.

``transactions`` is the fact table every sales operator reads:

    lineitem ⋈ orders (l_orderkey = o_orderkey) ⋈ part (l_partkey = p_partkey)

At scale lineitem ⋈ orders is the one big shuffle join (both sides grow with
the data); Spark plans it as a sort-merge join hash-partitioned on the order
key, so any later aggregation on ``transaction_id`` reuses that partitioning.
``part`` is joined without a hint: AQE turns it into a broadcast join only
when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``.

Money is carried as ``DECIMAL(18,2)`` so sums are exact and independent of
row order; it is cast to double only in the final projection of a query.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haat.sources.tables import snapshot_key, table


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``transactions`` table (logical columns, see ``schemas.TRANSACTIONS``)."""
    return transactions_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
                             table(spark, sf_dir, "part"))


def transactions_from(li: DataFrame, od: DataFrame, pt: DataFrame,
                      part_first: bool = True) -> DataFrame:
    """The adapter over any ``lineitem`` / ``orders`` / ``part`` frames (raw
    Parquet, bucketed tables, or filtered subsets).

    By default ``part`` is joined first and ``orders`` last: whether the part
    join is a broadcast or a shuffle join, the result ends up
    hash-partitioned by the order key, so order-level aggregations
    (``transaction_id``) need no further exchange.  When lineitem and orders
    are bucketed by the order key (``layout``), ``part_first=False`` joins
    them first, bucket by bucket, without any shuffle."""
    part, order = li.l_partkey == pt.p_partkey, li.l_orderkey == od.o_orderkey
    joined = (li.join(pt, part, "left").join(od, order, "left") if part_first else
              li.join(od, order, "left").join(pt, part, "left"))
    return (
        joined
        .select(
            li.l_orderkey.alias("transaction_id"),
            od.o_orderdate.alias("order_ts"),
            od.o_orderdate.cast("date").alias("dt"),
            pt.p_type.alias("product"),
            pt.p_type.alias("category"),
            pt.p_brand.alias("brand"),
            pt.p_name.alias("product_name"),
            li.l_quantity.cast("int").alias("quantity"),
            F.try_divide(li.l_extendedprice, li.l_quantity).alias("price"),
            li.l_extendedprice.cast("decimal(18,2)").alias("total_amount"),
            od.o_custkey.alias("user_id"),
            (li.l_discount > 0).alias("discount_applied"),
        )
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``transactions`` without the order columns (``dt``, ``user_id``).

    Product-only metrics do not need ``orders``.  All views keep every line
    (unknown orders and parts give NULL columns), so leaving the join out
    changes no result and removes the one shuffle join that grows on both
    sides."""
    li = table(spark, sf_dir, "lineitem")
    pt = table(spark, sf_dir, "part")
    return li.join(pt, li.l_partkey == pt.p_partkey, "left").select(
        li.l_orderkey.alias("transaction_id"),
        pt.p_type.alias("product"),
        pt.p_type.alias("category"),
        pt.p_brand.alias("brand"),
        pt.p_name.alias("product_name"),
        li.l_quantity.cast("int").alias("quantity"),
        F.try_divide(li.l_extendedprice, li.l_quantity).alias("price"),
        li.l_extendedprice.cast("decimal(18,2)").alias("total_amount"),
        (li.l_discount > 0).alias("discount_applied"),
    )


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: date, customer, exact revenue, line and unit counts.

    Lines are summed per order key *before* meeting ``orders`` (partial
    aggregation map-side), so the join sees one row per order instead of one
    per line.  Date- and customer-level metrics (monthly, weekday, RFM) are
    exact sums of these rows.  The output stays hash-partitioned by order
    key."""
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders")
    per = li.groupBy(F.col("l_orderkey")).agg(
        F.sum(li.l_extendedprice.cast("decimal(18,2)")).alias("total_amount"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(li.l_quantity.cast("int")).alias("quantity"))
    return per.join(od, per.l_orderkey == od.o_orderkey, "left").select(
        per.l_orderkey.alias("transaction_id"),
        od.o_orderdate.cast("date").alias("dt"),
        od.o_custkey.alias("user_id"),
        "total_amount", "n_lines", "quantity")


def social_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``social_sentiment(date, product, sentiment)`` from ``events``:
    one score per event, clamped to the reference range [0.35, 0.95]."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        ev.ts.cast("date").alias("date"),
        ev.event_type.alias("product"),
        F.greatest(F.lit(0.35), F.least(F.lit(0.95), ev.value / 100.0)).alias("sentiment"),
    )


# Which product an event type speaks about; types not named concern none.
EVENT_PRODUCTS = {"view": "STANDARD", "click": "PROMO", "purchase": "LARGE", "signup": "SMALL"}


def product_sentiment(spark: SparkSession, sf_dir: str, products: dict[str, str] | None = None) -> DataFrame:
    """``social_sentiment`` with event types replaced by the products that
    ``products`` names for them; other events are left out."""
    names = F.create_map(*[F.lit(x) for item in (products or EVENT_PRODUCTS).items() for x in item])
    sent = social_sentiment(spark, sf_dir)
    return sent.withColumn("product", F.element_at(names, F.col("product"))).where(F.col("product").isNotNull())


_AS_OF_MEMO: dict[tuple, _dt.date] = {}


def resolve_as_of(spark: SparkSession, sf_dir: str, as_of=None) -> _dt.date:
    """The reference date of all period filters.

    An explicit value wins.  Otherwise it is the newest order date that has
    lines — one scalar, remembered per input snapshot (file names, sizes, modification times).
    Turning it into a literal lets ``dt > as_of - 30`` reach the Parquet scan
    as a pushed filter on ``o_orderdate``.
    """
    if as_of is not None:
        if isinstance(as_of, str):
            return _dt.date.fromisoformat(as_of)
        if isinstance(as_of, _dt.datetime):
            return as_of.date()
        return as_of
    key = snapshot_key(os.path.join(sf_dir, "orders.parquet"))
    if key is not None and key in _AS_OF_MEMO:
        return _AS_OF_MEMO[key]
    od = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    value = od.join(li, "o_orderkey", "left_semi").agg(F.max(F.col("o_orderdate").cast("date")).alias("as_of")) \
        .first()["as_of"]
    if key is not None:
        _AS_OF_MEMO[key] = value
    return value


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: lines, lines without an order, lines without a part, orders
    without lines.  Each view keeps such lines with NULL columns."""
    li, od, pt = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    keys = od.select(F.col("o_orderkey").alias("l_orderkey")).distinct()
    used = li.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).select(name).scalar().alias(name)
    return spark.range(1).select(
        n(li, "n_lines"), n(li.join(keys, "l_orderkey", "left_anti"), "lines_without_order"),
        n(li.join(pt, li.l_partkey == pt.p_partkey, "left_anti"), "lines_without_part"),
        n(od.join(used, "o_orderkey", "left_anti"), "orders_without_lines"))


def conform_sales(df: DataFrame) -> DataFrame:
    """Bring a reference-shaped sales frame onto ``schemas.TRANSACTIONS``.

    Accepts the 4-, 5- and 9-column layouts (``date`` as text or date,
    ``product``, ``quantity``, ``price`` and optionally ``user_id``,
    ``transaction_id``, ``category``, ``product_name``, ``discount_applied``).
    Missing optional columns are decided once, while the plan is built (P14):
    ``transaction_id`` falls back to a hash of the row, which does not depend
    on how the file is split (equal rows share it), ``user_id`` to NULL.
    """
    cols = set(df.columns)
    price = F.col("price").cast("double")
    qty = F.col("quantity").cast("int")
    dt = F.to_date(F.col("date"))                                   # P4
    opt = (lambda name, default: F.col(name) if name in cols else default)
    return df.select(
        opt("transaction_id", F.xxhash64(*[F.col(c) for c in df.columns])).cast("long").alias("transaction_id"),
        dt.cast("timestamp_ntz").alias("order_ts"),
        dt.alias("dt"),
        F.col("product").cast("string").alias("product"),
        opt("category", F.col("product")).cast("string").alias("category"),
        opt("category", F.col("product")).cast("string").alias("brand"),
        opt("product_name", F.col("product")).cast("string").alias("product_name"),
        qty.alias("quantity"),
        price.alias("price"),
        (qty * price).cast("decimal(18,2)").alias("total_amount"),       # P2
        opt("user_id", F.lit(None)).cast("long").alias("user_id"),
        opt("discount_applied", F.lit(None)).cast("boolean").alias("discount_applied"),
    )
