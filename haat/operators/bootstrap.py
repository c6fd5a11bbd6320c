"""Gaps between groups with intervals (M13) by the Poisson bootstrap.

A replicate gives every row a weight drawn from Poisson(1), which stands for
the number of times a resample would hold it.  The weight comes from the md5
of the row's key and the replicate's block, so it is the same wherever and
however often a task runs, and nothing is resampled or shuffled: one md5 has
32 hex digits, four for each of eight replicates, and the weighted sums of
all replicates are one aggregate with map-side combination.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haat.functions.numeric import rnd, safe_div
from haat.operators import forecast

PER_BLOCK = 8       # replicates read from one md5


def poisson_cuts() -> list[str]:
    """The distribution function of Poisson(1) at 0, 1, ... in 65,536ths, as
    four hex digits: a weight is the number of cuts not above its digits."""
    cuts, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if round(total * 65536) > 0xFFFF:
            return cuts
        cuts.append(f"{round(total * 65536):04x}")
        k += 1


def poisson_weight(digits: Column) -> Column:
    cuts = poisson_cuts()
    w = F.when(digits < cuts[0], 0)
    for k, cut in enumerate(cuts[1:], 1):
        w = w.when(digits < cut, k)
    return w.otherwise(len(cuts))


def replicate_sums(df: DataFrame, group: Column, value: Column, key: Column, replicates: int) -> DataFrame:
    """(group, replicate, n, s, n_rows, total): the weighted number and sum of
    ``value`` per replicate, and the plain ones."""
    if replicates < PER_BLOCK or replicates % PER_BLOCK:
        raise ValueError(f"replicates must be a multiple of {PER_BLOCK}")
    rows = df.select(group.alias("group"), value.cast("double").alias("y"), key.cast("string").alias("key")) \
        .filter("y is not null")
    drawn = rows.select("group", "y", "key", F.explode(F.sequence(F.lit(0), F.lit(replicates // PER_BLOCK - 1))).alias("b")) \
        .withColumn("h", F.md5(F.concat(F.coalesce("key", F.lit("")), F.lit("|"), F.col("b").cast("string"))))
    w = [poisson_weight(F.substring("h", 4 * i + 1, 4)) for i in range(PER_BLOCK)]
    sums = drawn.groupBy("group", "b").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("total"),
        *[F.sum(w[i]).alias(f"n{i}") for i in range(PER_BLOCK)],
        *[F.sum(w[i] * F.col("y")).alias(f"s{i}") for i in range(PER_BLOCK)])
    each = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i in range(PER_BLOCK)])
    return sums.select("group", "n_rows", "total", "b", F.posexplode(each).alias("i", "r")).select(
        "group", (F.col("b") * PER_BLOCK + F.col("i")).alias("replicate"), "r.n", "r.s", "n_rows", "total")


def group_gaps(df: DataFrame, group: Column, value: Column, key: Column, replicates: int = 200,
               level: float = 0.95) -> DataFrame:
    """Per group, against all rows of the other groups: n_rows, mean, rest
    (the others' mean), gap = mean - rest and ratio = mean / rest, with the
    central ``level`` of each over the replicates.

    ``key`` names a row; rows that share a key share their weights.  Null
    values do not count; a null group is a group.  With one group alone there
    is no rest, so gap and ratio are null; an empty table gives none.
    """
    reps = replicate_sums(df, group, value, key, replicates)
    all_groups = Window.partitionBy("replicate")             # one row per group

    def others(c: str) -> Column:
        return F.sum(c).over(all_groups) - F.col(c)

    mean, rest = safe_div(F.col("s"), F.col("n")), safe_div(others("s"), others("n"))
    m0, r0 = safe_div(F.col("total"), F.col("n_rows")), safe_div(others("total"), others("n_rows"))
    each = reps.select("group", "n_rows", m0.alias("mean"), r0.alias("rest"), (mean - rest).alias("gap"),
                       safe_div(mean, rest).alias("ratio"))
    low, high = (1 - level) / 2, (1 + level) / 2
    out = each.groupBy("group").agg(
        F.max("n_rows").alias("n_rows"), F.max("mean").alias("mean"), F.max("rest").alias("rest"),
        *[F.percentile(c, p).alias(f"{c}_{end}") for c in ("gap", "ratio") for end, p in (("low", low), ("high", high))])
    return out.select("group", "n_rows", *[rnd(c, 4).alias(n) for n, c in (
        ("mean", F.col("mean")), ("rest", F.col("rest")), ("gap", F.col("mean") - F.col("rest")),
        ("gap_low", F.col("gap_low")), ("gap_high", F.col("gap_high")),
        ("ratio", safe_div(F.col("mean"), F.col("rest"))), ("ratio_low", F.col("ratio_low")),
        ("ratio_high", F.col("ratio_high")))])


def error_gaps(tx_or_daily: DataFrame, replicates: int = 200) -> DataFrame:
    """Absolute in-sample errors of the day-grain model by product, as
    ``forecast.error_by_group``, each product against the others."""
    r = forecast.fit(tx_or_daily, "day")["resid"]
    return group_gaps(r, F.col("product"), F.abs("s1"), F.concat_ws("|", "product", F.col("dt").cast("string")), replicates)
