"""Numeric helpers: engine-stable rounding, guarded ratios, clamps, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column, n: int = 2) -> Column:
    """Round half-up to ``n`` places, as a double.

    The value passes through ``DECIMAL(38, n+4)`` first.  Rounding a binary
    double directly differs between engines at ties (``round(1.005, 2)``);
    the decimal detour makes every engine round the same digits.
    """
    return F.round(c.cast(f"decimal(38,{n + 4})"), n).cast("double")


def fmt2(c: Column) -> Column:
    """Text of a number with exactly two decimals (the ``:.2f`` format)."""
    return F.round(c.cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")


def money(c: Column) -> Column:
    """Exact decimal money → double for the final projection."""
    return c.cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as doubles, NULL when ``den`` is 0 or NULL (ANSI-safe)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def pct_change(cur: Column, prev: Column) -> Column:
    """Guarded percent change (F16): ``(cur-prev)/prev*100`` when prev > 0, else 0."""
    c = cur.cast("double")
    p = prev.cast("double")
    return F.when(p > 0, (c - p) / p * 100.0).otherwise(F.lit(0.0))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """``max(lo, min(hi, c))``."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def trunc_int(c: Column) -> Column:
    """truncation toward zero, like Python ``int()``."""
    return c.cast("int")


def stock_status(days: Column) -> Column:
    """``< 7`` critical, ``< 14`` warning, else ok."""
    return (F.when(days < 7, F.lit("critical"))
            .when(days < 14, F.lit("warning"))
            .otherwise(F.lit("ok")))


def split_trim(c: Column, sep: str = ",") -> Column:
    """Comma list → array of trimmed items."""
    return F.transform(F.split(c, sep), lambda x: F.trim(x))


def line_count(df) -> Column:
    """Number of transaction lines: ``count(*)`` over line rows, or the sum
    of ``n_lines`` over pre-aggregated order rows (``adapter.order_totals``)."""
    return F.sum("n_lines") if "n_lines" in df.columns else F.count(F.lit(1))
