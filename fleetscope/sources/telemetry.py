"""Typed scans of collected relations, as batch or stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from fleetscope.schemas import TELEMETRY


def _stored(name: str) -> StructType:
    return StructType([*TELEMETRY[name].fields, StructField("collection_date", DateType())])


def read_telemetry(
    spark: SparkSession, root: str, name: str, since: date | None = None, servers: Sequence[int] | None = None
) -> DataFrame:
    """One relation with its declared schema, pruned by collection date and server.

    Relations are stored under ``root/name`` partitioned by ``collection_date``, so
    ``since`` skips whole folders; ``servers`` reaches the Parquet scan.
    """
    df = spark.read.schema(_stored(name)).parquet(f"{root}/{name}")
    if since is not None:
        df = df.filter(F.col("collection_date") >= F.lit(since))
    if servers is not None:
        df = df.filter(F.col("server_id").isin(*servers))
    return df


def stream_telemetry(spark: SparkSession, root: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The same relation as a file stream; the trigger size bounds each micro-batch."""
    return (
        spark.readStream.schema(_stored(name))
        .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/{name}")
    )


def union_databases(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Stack per-database results under a ``database_name`` column.

    Where the relation already carries its database, read it once instead.
    """
    named = [df.withColumn("database_name", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def inline_relation(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Constant rows, for rule and code tables."""
    return spark.createDataFrame(list(rows), schema)


def number_series(spark: SparkSession, count: int) -> DataFrame:
    """Numbers 1 to ``count``."""
    return spark.range(1, count + 1).withColumnRenamed("id", "number")
