"""Period predicates relative to an explicit ``as_of`` date.

The reference compares dates with "now" (a timestamp with a time of day),
so ``date >= now - 30 days`` keeps dates strictly after ``as_of - 30``.
All predicates are on ``dt`` (= ``CAST(o_orderdate AS DATE)``); Catalyst
rewrites them into timestamp ranges that are pushed into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Periods:
    as_of: _dt.date
    window_days: int = 30

    def _d(self, days_back: int) -> Column:
        return F.lit(self.as_of - _dt.timedelta(days=days_back))

    def _upto(self, dt: Column) -> Column:
        """Nothing after ``as_of`` counts (matters for an explicit, earlier
        ``as_of``; the default is the newest date, so it is a no-op there)."""
        return dt <= F.lit(self.as_of)

    def last(self, dt: Column) -> Column:
        """The trailing window, ``as_of - 30 < dt <= as_of``."""
        return (dt > self._d(self.window_days)) & self._upto(dt)

    def previous(self, dt: Column) -> Column:
        """``as_of - 60 < dt <= as_of - 30``."""
        return (dt > self._d(2 * self.window_days)) & (dt <= self._d(self.window_days))

    def where_last(self, df):
        """Rows of the trailing window.  On a month-partitioned fact table
        (``layout.write_fact_table``) the matching ``month`` predicate is
        added so whole partitions are pruned, not only row groups."""
        out = df.where(self.last(F.col("dt")))
        if "month" in df.columns:
            lo = self.as_of - _dt.timedelta(days=self.window_days - 1)
            out = out.where(F.col("month") >= F.lit(lo.replace(day=1)))
        return out

    def today(self, dt: Column) -> Column:
        return dt == F.lit(self.as_of)

    def week_start(self) -> _dt.date:
        return self.as_of - _dt.timedelta(days=self.as_of.weekday())

    def month_start(self) -> _dt.date:
        return self.as_of.replace(day=1)

    def this_week(self, dt: Column) -> Column:
        """Since Monday of the as-of week."""
        return (dt >= F.lit(self.week_start())) & self._upto(dt)

    def this_month(self, dt: Column) -> Column:
        """Since the first of the as-of month."""
        return (dt >= F.lit(self.month_start())) & self._upto(dt)
