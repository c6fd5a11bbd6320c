"""Per-run context shared by the registered queries."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from haat.functions.periods import Periods
from haat.sources import adapter


@dataclass
class Ctx:
    spark: SparkSession
    sf_dir: str
    as_of_param: object = None
    _as_of: _dt.date | None = field(default=None, init=False)

    @property
    def tx(self) -> DataFrame:
        return adapter.transactions(self.spark, self.sf_dir)

    @property
    def lines(self) -> DataFrame:
        """Line rows without order columns (no orders join)."""
        return adapter.lines(self.spark, self.sf_dir)

    @property
    def orders(self) -> DataFrame:
        """One row per order, lines pre-aggregated before the orders join."""
        return adapter.order_totals(self.spark, self.sf_dir)

    @property
    def as_of(self) -> _dt.date:
        if self._as_of is None:
            self._as_of = adapter.resolve_as_of(self.spark, self.sf_dir, self.as_of_param)
        return self._as_of

    @property
    def periods(self) -> Periods:
        return Periods(self.as_of)
