"""haat — retail analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or
``(SparkSession, ...) -> DataFrame`` for sources).  Nothing inside the
operators collects data to the driver; the only driver round trip is the
optional resolution of the ``as_of`` date (one scalar) so that period
filters become literals that reach the Parquet scan.
"""

from haat.session import get_spark, scratch_dir  # noqa: F401

__all__ = ["get_spark", "scratch_dir"]
