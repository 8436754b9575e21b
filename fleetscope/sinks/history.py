"""History tables: Parquet folders partitioned by collection date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscope.runtime import cut_lineage

# Rows a day's folder may hold per file before it is split further.
ROWS_PER_FILE = 5_000_000


def _dated(df: DataFrame, time: str, partition: str) -> DataFrame:
    return df.withColumn(partition, F.to_date(time))


def _write(df: DataFrame, path: str, mode: str, partition: str) -> None:
    # One shuffle gathers each day; adaptive execution splits a heavy day and joins
    # light ones, so neither many small files nor one giant task result.
    (
        df.hint("rebalance", partition).write.mode(mode)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )


def append_history(df: DataFrame, path: str, schema: StructType, time: str, partition: str = "collection_date") -> None:
    """Append the columns of ``schema``, in its order and types."""
    shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    _write(_dated(shaped, time, partition), path, "append", partition)


def append_by_name(df: DataFrame, table: str) -> None:
    """Append to a catalog table, columns matched by name."""
    df.select(*df.sparkSession.table(table).columns).write.insertInto(table)


def replace_day(df: DataFrame, path: str, time: str, day: date, partition: str = "audit_date") -> None:
    """Load one day again: its folder is replaced, all others stay. Without rows for the day it goes."""
    only = df.filter((F.col(time) >= F.lit(day)) & (F.col(time) < F.lit(day + timedelta(days=1))))
    if only.isEmpty():
        return drop_days(df.sparkSession, path, [day], partition)
    _write(_dated(only, time, partition), path, "overwrite", partition)


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_days(spark: SparkSession, path: str, partition: str = "collection_date") -> list[date]:
    """Days a table holds, from its folder names; no file is opened."""
    folder, files = _file_system(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith(f"{partition}=2") or n.startswith(f"{partition}=1"))


def expired_days(spark: SparkSession, path: str, now: datetime, days: int, partition: str = "collection_date") -> list[date]:
    """Stored days older than the retention."""
    boundary = now.date() - timedelta(days=days)
    return [day for day in stored_days(spark, path, partition) if day < boundary]


def drop_days(spark: SparkSession, path: str, expired: Sequence[date], partition: str = "collection_date") -> None:
    """Remove whole day folders; no row is read or rewritten."""
    for day in expired:
        folder, files = _file_system(spark, f"{path}/{partition}={day.isoformat()}")
        files.delete(folder, True)


def purge_days(spark: SparkSession, path: str, now: datetime, days: int, partition: str = "collection_date") -> list[date]:
    """Drop the days that have left the retention and tell which."""
    expired = expired_days(spark, path, now, days, partition)
    drop_days(spark, path, expired, partition)
    return expired


def purge_instants(
    spark: SparkSession, path: str, schema: StructType, time: str, now: datetime, days: int, partition: str = "collection_date"
) -> list[date]:
    """Drop what is older than an instant: whole days, and the older rows of the boundary day."""
    expired = purge_days(spark, path, now, days, partition)
    boundary = now - timedelta(days=days)
    if boundary.date() in stored_days(spark, path, partition):
        rows = spark.read.schema(schema).parquet(f"{path}/{partition}={boundary.date().isoformat()}")
        # Frozen first: the folder that is read is the one that is replaced.
        replace_day(cut_lineage(rows.filter(F.col(time) >= F.lit(boundary))), path, time, boundary.date(), partition)
    return expired


def read_history(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored columns of a table, without the partition column."""
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])
