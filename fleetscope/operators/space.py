"""File space of databases and of temp space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import bit_set, int_div, megabytes, whole_megabytes
from fleetscope.keys import K

# Growth-in-percent flag of a file and the free-space alert level.
PERCENT_GROWTH = 0x100000
FREE_PERCENT_ALERT = 40


def database_space(files: DataFrame) -> DataFrame:
    """Size, use and free space of every database file, in MB."""
    size = megabytes(F.col("size_pages"))
    free = (size - megabytes(F.col("used_pages"), 7)).cast("decimal(18,2)")
    return files.select(
        "server_id", F.col("collection_time").alias("poll_date"), "database_name", "logical_name",
        F.when(F.col("file_type") == "ROWS", "DATA").otherwise(F.col("file_type")).alias("file_type"),
        "filegroup_name", F.col("physical_name").alias("physical_file_location"),
        size.alias("space_mb"), whole_megabytes(F.col("used_pages")).alias("used_space_mb"), free.alias("free_space_mb"),
    )


def temp_space(files: DataFrame) -> DataFrame:
    """Temp-space files with size, use, free share and growth text."""
    size, used = F.col("size_pages"), F.col("used_pages")
    wide = "decimal(19,0)"
    share = ((size - used).cast(wide) / F.nullif(size, F.lit(0)).cast(wide)).cast("decimal(5,3)")
    mb = F.lit(" MB")
    return files.select(
        "server_id", F.lit("TempDB").alias("database_name"), F.col("logical_name").alias("logical_file_name"),
        F.col("physical_name").alias("physical_file_name"), F.col("database_status").alias("status"),
        "updateability", "recovery_mode", whole_megabytes(size).alias("file_size_mb"), whole_megabytes(used).alias("space_used_mb"),
        int_div(size - used, 128).alias("free_space_mb"),
        F.concat((share * 100).cast("decimal(8,3)").cast("string"), F.lit("%")).alias("free_space_pct"),
        F.when(F.col("max_size_pages") == -1, "Unlimited")
        .otherwise(F.concat(int_div(F.col("max_size_pages"), 128).cast("string"), mb)).alias("max_size"),
        F.when(bit_set(F.col("file_flags"), PERCENT_GROWTH), F.concat(F.col("growth").cast("string"), F.lit("%")))
        .otherwise(F.concat(int_div(F.col("growth"), 128).cast("string"), mb)).alias("growth"),
        F.col("collection_time").alias("poll_date"),
    )


def min_free_space(space: DataFrame, threshold: int = FREE_PERCENT_ALERT) -> DataFrame:
    """Lowest whole free percent per server and poll, and whether it calls for a closer look."""
    percent = F.regexp_extract("free_space_pct", r"^(-?\d+)", 1).try_cast("bigint")
    return (
        space.groupBy("server_id", "poll_date").agg(F.min(percent).alias("min_free_percent"))
        .withColumn("needs_drilldown", F.col("min_free_percent") < threshold)
    )


def database_sizes(files: DataFrame) -> DataFrame:
    """Pages of data files per database."""
    return files.filter("file_type = 'ROWS'").groupBy("server_id", "database_name").agg(
        F.sum("size_pages").alias("database_pages")
    )


def extent_usage(file_space: DataFrame) -> DataFrame:
    """Allocated and modified extent pages per database."""
    return file_space.groupBy(*K, "database_name").agg(
        F.sum("allocated_extent_pages").alias("allocated_pages"), F.sum("modified_extent_pages").alias("modified_pages")
    )
