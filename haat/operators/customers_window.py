"""Distinct customers over any trailing window (A3), from mergeable bitmaps.

The facts are read once, into one bitmap of customers per (product, day,
bucket of 32,768 ids).  Distinct counts do not add up over days, but bitmaps
merge.  A trailing window of w days spans at most two of the calendar's
stretches of w days: it is the end of one and the beginning of the next.  So
with running unions from each stretch's first day on, and back from its last
day, every window is the union of two bitmaps, whatever w.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = _dt.date(1970, 1, 1)


def daily_bitmaps(tx: DataFrame, key: str = "product", member: str = "user_id", day: str = "dt") -> DataFrame:
    """(key, dt, bucket, bits): the members seen on a day, combined map-side."""
    m = F.col(member).cast("long")
    return tx.filter(m.isNotNull() & F.col(day).isNotNull()).groupBy(
        F.col(key).alias("key"), F.col(day).alias("dt"), F.bitmap_bucket_number(m).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(m)).alias("bits"))


def trailing_distinct(bitmaps: DataFrame, days: int = 30) -> DataFrame:
    """(key, dt, members): for every day from a key's first to its last, the
    distinct members of the ``days`` days that end there."""
    n = F.datediff("dt", F.lit(EPOCH))
    at = bitmaps.withColumn("n", n)
    # The days a bucket can matter for, within the key's span.
    span = at.groupBy("key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    reach = at.groupBy("key", "bucket").agg(F.min("n").alias("a"), F.max("n").alias("b")).join(span, "key")
    # Whole stretches: the running unions need a row for every day of them.
    spine = reach.select("key", "bucket", "hi", F.explode(F.sequence(
        F.expr(f"(a div {days}) * {days}"),
        F.expr(f"(least(hi, b + {days - 1}) div {days}) * {days} + {days - 1}"))).alias("n"))
    full = spine.join(at.select("key", "bucket", "n", "bits"), ["key", "bucket", "n"], "left") \
        .withColumn("stretch", F.expr(f"n div {days}"))
    part = Window.partitionBy("key", "bucket", "stretch")
    so_far = (Window.unboundedPreceding, 0)
    ahead = F.bitmap_or_agg("bits").over(part.orderBy("n").rowsBetween(*so_far))
    back = F.bitmap_or_agg("bits").over(part.orderBy(F.col("n").desc()).rowsBetween(*so_far))
    runs = full.select("key", "bucket", "hi", "n", ahead.alias("ahead"), back.alias("back"))
    # The window that ends on day n: from n - days + 1 to its stretch's end, and from there to n.
    pairs = runs.select("key", "bucket", "hi", "n", F.col("ahead").alias("bits")).unionByName(
        runs.select("key", "bucket", "hi", (F.col("n") + days - 1).alias("n"), F.col("back").alias("bits")))
    merged = pairs.filter(F.col("n") <= F.col("hi")).groupBy("key", "bucket", "n") \
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    counts = merged.groupBy("key", "n").agg(F.sum(F.bitmap_count("bits")).alias("members"))
    every = span.select("key", F.explode(F.sequence("lo", "hi")).alias("n"))
    return every.join(counts, ["key", "n"], "left").select(
        "key", F.date_add(F.lit(EPOCH), F.col("n")).alias("dt"),
        F.coalesce(F.col("members"), F.lit(0)).cast("long").alias("members"))


def customers_trailing(tx: DataFrame, days: int = 30) -> DataFrame:
    """A3 for every product and day of its span."""
    return trailing_distinct(daily_bitmaps(tx), days).select(
        F.col("key").alias("product"), "dt", F.col("members").alias("customers"))
