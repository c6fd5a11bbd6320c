"""Column-level helpers (scalar functions F1–F27).  All return ``Column``
expressions built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF."""
