"""File sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header line, written in parallel (one file per task)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds the path.  Only "not found" counts as absent; any
    other error (permission, network) is raised."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_csv(spark: SparkSession, path: str, schema: StructType,
             fallback: DataFrame | None = None) -> DataFrame:
    """S3: CSV scan with a declared schema; when the file is missing the
    ``fallback`` frame is used (the reference regenerates data in that case)."""
    if fallback is not None and not path_exists(spark, path):
        return fallback
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Replace (``overwrite``) or ``append`` a Parquet table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_dedup(spark: SparkSession, path: str, keys: list[str], newest: str = "batch_id") -> DataFrame:
    """S6 read side: of the rows appended for a key the one with the largest
    ``newest`` counts (``max_by``, combined map-side)."""
    t = spark.read.parquet(path)
    rest = [c for c in t.columns if c not in (*keys, newest)]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_row")).select(*keys, "_row.*")


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant column (e.g. the product of a trend series)."""
    return df.withColumn(name, F.lit(value))



LINE = "_line"      # the raw text of a line that does not fit the schema


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, out: str,
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3 with bad lines set aside: (accepted rows, rejects).

    One scan writes both below ``out``, by a partition column, and both are
    read back.  A reject is the raw line and a reason: ``fields`` (more or
    fewer than the schema has) or ``value`` (one that does not parse)."""
    from pyspark.sql.types import StringType, StructField
    full = StructType([*schema.fields, StructField(LINE, StringType())])
    rows = spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", LINE).csv(path)
    rows.withColumn("rejected", F.col(LINE).isNotNull()).write.partitionBy("rejected").parquet(out)
    kept = spark.read.schema(StructType([*full.fields, StructField("rejected", StringType())])).parquet(out)
    # Commas within quotes separate nothing.
    n_fields = F.size(F.split(F.regexp_replace(LINE, '"[^"]*"', ""), ","))
    rejects = kept.filter("rejected = 'true'").select(
        F.when(n_fields != len(schema.fields), F.lit("fields")).otherwise(F.lit("value")).alias("reason"),
        F.col(LINE).alias("line"))
    return kept.filter("rejected = 'false'").drop(LINE, "rejected"), rejects


def _day_digests(df: DataFrame, day: str) -> DataFrame:
    """Per day the number of rows and two sums of row hashes: equal for equal
    rows in any order."""
    cols = sorted(c for c in df.columns if c != day)
    rows = df.select(day, F.xxhash64(*cols).alias("h"), F.hash(*cols).alias("g"))
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"),
                                 F.sum(F.col("g").cast("long")).alias("g"))


def ingest_days(df: DataFrame, path: str, day: str = "dt") -> DataFrame:
    """S6, S12 when a batch may come twice or overlap an earlier one: the
    batch replaces the days it holds, and days that it would not change are
    left alone.  Returns the days written.

    Days are partitions (``day`` may also be a coarser period, such as the
    month, where batches hold whole ones and days would make too many small
    files).  Stored days are compared by digests; only partitions
    of the batch's own days are read, and dynamic overwrite replaces only
    those that differ.  A failed run can be repeated.

    The batch is written once to a scratch folder, as it is read for the
    digests, the comparison and the replacement."""
    from haat.session import scratch_dir
    spark = df.sparkSession
    staged = scratch_dir(spark, "batch")
    df.write.parquet(staged)
    df = spark.read.schema(df.schema).parquet(staged)
    new = _day_digests(df, day)
    if path_exists(spark, path):
        stored = spark.read.parquet(path).join(df.select(day).distinct(), day, "left_semi").select(*df.columns)
        old = _day_digests(stored, day)
        new = new.join(old, [day, "n", "h", "g"], "left_anti")
    touched = scratch_dir(spark, "days-touched")
    new.select(day).write.parquet(touched)          # read before the partitions are replaced
    days = spark.read.parquet(touched)
    # One file a day, more where a day is large: adaptive execution splits it.
    df.join(days, day, "left_semi").hint("rebalance", day) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return days
