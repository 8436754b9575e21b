"""Scheduled collectors: what to append, and what leaves the history."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions import codes
from fleetscope.operators import filters, jobs, replicas, space, usage
from fleetscope.operators.retention import INSTANT_TABLES, RETENTION_DAYS, purge_history
from fleetscope.schemas import HISTORY
from fleetscope.sinks.history import append_history, purge_days, purge_instants, replace_day
from fleetscope.sources.cpu_records import parse_cpu_records


def store(spark: SparkSession, rows: DataFrame, path: str, table: str, time: str, now: datetime) -> list[date]:
    """Append a poll to its history table, then drop what has left the retention: days, or for some tables instants."""
    append_history(rows, path, HISTORY[table], time)
    if table in INSTANT_TABLES:
        return purge_instants(spark, path, HISTORY[table], time, now, RETENTION_DAYS[table])
    return purge_days(spark, path, now, RETENTION_DAYS[table])


def store_job_definitions(spark: SparkSession, definitions: DataFrame, roles: DataFrame, path: str, now: datetime) -> list[date]:
    """Store today's definitions of the primary servers, in place of earlier ones of today, and drop expired days.

    ``roles`` has ``server_id, role``. A day on which no primary has jobs keeps no rows.
    """
    primary = roles.filter("role = 'PRIMARY'").select("server_id").distinct()
    rows = definitions.join(primary, "server_id", "left_semi").withColumn("audit_date", F.lit(now))
    shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY["job_definitions"].fields])
    replace_day(shaped, path, "audit_date", now.date(), "collection_date")
    return purge_days(spark, path, now, RETENTION_DAYS["job_definitions"])


def cpu_history(records: DataFrame, clock: DataFrame, history: DataFrame, count: int = 15, minutes: int = 15) -> DataFrame:
    """CPU records to append: fresh, not stored yet, the newest ``count`` per server."""
    parsed = parse_cpu_records(records, clock, minutes)
    fresh = filters.latest_only(parsed, "collection_time", minutes)
    return filters.top_recent_records(filters.anti_join_new_records(fresh, history), count)


def cpu_history_after_poll(new: DataFrame, history: DataFrame, now: datetime) -> DataFrame:
    """CPU history as it stands after a poll."""
    columns = ["server_id", "record_id", "event_time", "sql_process", "system_idle", "other_process"]
    merged = history.select(*columns).unionByName(new.select(*columns))
    return purge_history(merged, "event_time", RETENTION_DAYS["cpu_usage"], "date", now)


def job_enabled_log(jobs_df: DataFrame, replica_states: DataFrame, groups: DataFrame, now: datetime) -> DataFrame:
    """Enabled state of every job with the role of its server."""
    roles = replicas.replica_role(replica_states, groups).select("server_id", F.col("role").alias("replica_role"))
    return jobs_df.join(roles, "server_id", "left").select(
        "server_id", F.lit(now).alias("audit_date"), "replica_role", "job_id", F.col("name").alias("job_name"),
        codes.decode(F.col("enabled"), codes.ENABLED).alias("is_enabled"),
    )


def job_definition_drift(definitions: DataFrame, roles: DataFrame) -> DataFrame:
    """Definitions that differ between each secondary and the primary of its group.

    ``roles`` has ``server_id, group_name, role``; servers in no group compare with nobody.
    """
    primaries = roles.filter("role = 'PRIMARY'").select("server_id", "group_name")
    secondaries = roles.filter("role = 'SECONDARY'").select("group_name", F.col("server_id").alias("secondary_id"))
    primary = definitions.join(primaries, "server_id").join(secondaries, "group_name")
    secondary = definitions.withColumn("secondary_id", F.col("server_id")).join(secondaries, "secondary_id")
    return jobs.definition_drift(primary, secondary, ["group_name", "secondary_id"])


def space_tracking(files: DataFrame) -> DataFrame:
    """File space rows to append."""
    return space.database_space(files)


def tempdb_tracking(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Temp-space rows to append, and the polls that need a closer look."""
    rows = space.temp_space(files)
    return rows, space.min_free_space(rows)


def tempdb_requests(polls: DataFrame, task_space: DataFrame, session_space: DataFrame, sessions: DataFrame) -> DataFrame:
    """Temp space per request for the polls that need a closer look."""
    low = polls.filter("needs_drilldown").select("server_id", F.col("poll_date").alias("collection_time")).distinct()
    used = usage.tempdb_usage(task_space, session_space, sessions)
    return used.join(low, ["server_id", "collection_time"], "left_semi").withColumnRenamed("collection_time", "poll_date")
