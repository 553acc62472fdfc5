"""The events table: Parquet, partitioned by day and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT_COLUMNS, EVENT_SCHEMA

PARTITION_COLUMNS = ["timestamp_day", "customer_id"]
TABLE_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("timestamp_day", T.DateType())])


def ensure_events_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The catalog table ``name`` over ``path``, created when missing."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLE_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)}) LOCATION '{path}'")
    return spark.table(name)


def table_rows(df: DataFrame) -> DataFrame:
    """``df`` in table form: absent columns become null, the day is added."""
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None))
               .cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    return df.select(*columns).withColumn("timestamp_day", F.to_date("timestamp"))


def append_events(df: DataFrame, path: str) -> None:
    """Append rows. The rebalance hint gathers small partitions into one file each and
    splits a customer that dominates a day over several tasks."""
    (table_rows(df).hint("rebalance", *PARTITION_COLUMNS)
     .write.mode("append").partitionBy(*PARTITION_COLUMNS).parquet(path))


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """Write the rows of one micro-batch, below the folder ``batch`` of each day and customer.
    Repeating a batch replaces what it wrote. Hot customers are split as in ``append_events``."""
    (table_rows(df).withColumn("batch", F.lit(batch)).hint("rebalance", *PARTITION_COLUMNS)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITION_COLUMNS, "batch").parquet(path))


def pin_events(spark: SparkSession, path: str, pin: str) -> None:
    """Save at ``pin`` which files the table at ``path`` consists of now, so that the queries of
    one investigation can all read the same rows."""
    files = read_events(spark, path).inputFiles()
    spark.createDataFrame([(f,) for f in files], "file STRING").write.mode("overwrite").parquet(pin)


def read_pinned(spark: SparkSession, path: str, pin: str) -> DataFrame:
    """The table as it was when it was pinned, whatever was appended since."""
    files = [r.file for r in spark.read.schema("file STRING").parquet(pin).collect()]
    if not files:
        return spark.createDataFrame([], TABLE_SCHEMA).select(*EVENT_COLUMNS, "timestamp_day")
    return spark.read.schema(TABLE_SCHEMA).option("basePath", path).parquet(*files).select(
        *EVENT_COLUMNS, "timestamp_day")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The table as of now: the file list is fixed when the DataFrame is made, so later
    appends do not show. The stated schema keeps customer ids text."""
    return spark.read.schema(TABLE_SCHEMA).parquet(path).select(*EVENT_COLUMNS, "timestamp_day")


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TABLE_SCHEMA).parquet(path).select(*EVENT_COLUMNS)


def compact_day(spark: SparkSession, path: str, target: str, day: str) -> None:
    """Write one closed day of the table at ``path`` to ``target`` in few large files.

    Only that day's partitions of the target are replaced, so a failed run can be
    repeated."""
    rows = read_events(spark, path).where(F.col("timestamp_day") == F.lit(day).cast("date"))
    (rows.hint("rebalance", *PARTITION_COLUMNS)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITION_COLUMNS).parquet(target))
