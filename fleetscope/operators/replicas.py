"""Replica roles and synchronization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.ranking import best_row


def replica_role(replica_states: DataFrame, groups: DataFrame) -> DataFrame:
    """Local role of each server in its availability group, one row per server.

    A server in several groups reports the latest collection, then the group that
    sorts last by name.
    """
    joined = replica_states.filter("is_local").join(
        groups.select("server_id", "group_id", F.col("name").alias("group_name")), ["server_id", "group_id"]
    )
    return best_row(joined, ["server_id"], [F.col("collection_time"), F.col("group_name"), F.col("role")], ["group_name", "role"])


def replica_gate(df: DataFrame, roles: DataFrame, role: str = "PRIMARY") -> DataFrame:
    """Rows from servers that currently hold ``role``."""
    return df.join(roles.filter(F.col("role") == role), "server_id", "left_semi")


def unsynced_databases(databases: DataFrame, replica_states: DataFrame, ignored: DataFrame) -> DataFrame:
    """User databases that are missing from their group or not healthy in it.

    Databases on the ignore list and the four system databases are left out.
    """
    at = ["server_id", "collection_time", "database_id"]
    states = replica_states.select(*at, "synchronization_state", "synchronization_health").withColumn("_known", F.lit(True))
    absent = (F.col("state") != "OFFLINE") & F.col("_known").isNull()
    broken = (F.col("synchronization_state") != "SYNCHRONIZED") | (F.col("synchronization_health") != "HEALTHY")
    return (
        databases.filter("database_id > 4")
        .join(ignored.select("server_id", F.col("database_name").alias("name")), ["server_id", "name"], "left_anti")
        .join(states, at, "left").filter(absent | broken)
        .drop("_known")
    )
