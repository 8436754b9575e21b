"""Scheduled-job definitions and their drift between servers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import codes

# Columns compared between two servers; text is lower-cased where the flag is set.
COMPARED = {
    "job_name": True, "job_owner": False, "job_category": False, "job_description": True, "job_start_step_no": False,
    "job_start_step_name": True, "is_scheduled": False, "job_schedule_name": True, "job_deletion_criterion": False,
    "schedule_type": False, "occurrence": False, "recurrence": False, "frequency": False, "schedule_usage_end_date": False,
    "step_no": False, "step_name": True, "step_type": True, "run_as": False, "database_name": True,
    "on_success_action": False, "retry_attempts": False, "retry_interval": False, "on_failure_action": False,
    "executable_command": True,
}


def job_definition_view(
    jobs: DataFrame, steps: DataFrame, schedules: DataFrame, job_schedules: DataFrame, categories: DataFrame,
    proxies: DataFrame, owners: DataFrame, servers: DataFrame,
) -> DataFrame:
    """Every job with its steps, schedule, owner, category and proxy, decoded to text.

    Jobs without steps, schedule or owner stay. The two step targets are self-joins on
    (job, step), before the wide columns of the job come in; jobs, steps and schedules then meet on one key.
    """
    def side(df: DataFrame, keys: list[str], **renamed: str) -> DataFrame:
        return df.select("server_id", *keys, *[F.col(c).alias(n) for n, c in renamed.items()])

    success = side(steps, ["job_id"], on_success_step_id="step_id", _success_name="step_name")
    failure = side(steps, ["job_id"], on_fail_step_id="step_id", _failure_name="step_name")
    step = (
        steps.withColumnRenamed("database_name", "step_database")
        .join(success, ["server_id", "job_id", "on_success_step_id"], "left")
        .join(failure, ["server_id", "job_id", "on_fail_step_id"], "left")
    )
    schedule = schedules.withColumnsRenamed({
        "name": "_schedule_name", "date_created": "schedule_created_on", "date_modified": "schedule_last_modified_on",
    }).withColumn("_scheduled", F.lit(True))
    joined = (
        jobs.withColumnsRenamed({"name": "job_name", "description": "job_description"})
        .join(side(servers, ["originating_server_id"], originating_server_name="name"), ["server_id", "originating_server_id"], "left")
        .join(side(categories, ["category_id"], job_category="name"), ["server_id", "category_id"], "left")
        .join(side(owners, ["owner_sid"], job_owner="name"), ["server_id", "owner_sid"], "left")
        .join(step, ["server_id", "job_id"], "left")
        .join(job_schedules.select("server_id", "job_id", "schedule_id"), ["server_id", "job_id"], "left")
        .join(side(proxies, ["proxy_id"], run_as="name"), ["server_id", "proxy_id"], "left")
        .join(schedule, ["server_id", "schedule_id"], "left")
    )
    c = F.col
    return joined.select(
        "server_id", "job_id", "job_name", "job_owner", "job_category", "job_description",
        codes.decode(c("enabled"), codes.ENABLED).alias("is_enabled"),
        c("date_created").alias("job_created_on"), c("date_modified").alias("job_last_modified_on"),
        "originating_server_name", c("step_id").alias("job_start_step_no"), c("step_name").alias("job_start_step_name"),
        F.when(c("_scheduled"), "Yes").otherwise("No").alias("is_scheduled"), c("_schedule_name").alias("job_schedule_name"),
        codes.decode(c("delete_level"), codes.DELETION_RULES).alias("job_deletion_criterion"),
        codes.schedule_type(c("freq_type")).alias("schedule_type"), codes.occurrence(c("freq_type")).alias("occurrence"),
        codes.recurrence(c("freq_type"), c("freq_interval"), c("freq_recurrence_factor"), c("freq_relative_interval")).alias("recurrence"),
        codes.frequency(c("freq_subday_type"), c("freq_subday_interval"), c("active_start_time"), c("active_end_time")).alias("frequency"),
        codes.date_text(c("active_start_date")).alias("schedule_usage_start_date"),
        codes.date_text(c("active_end_date")).alias("schedule_usage_end_date"),
        "schedule_created_on", "schedule_last_modified_on",
        c("step_id").alias("step_no"), "step_name", codes.step_type(c("subsystem")).alias("step_type"), "run_as",
        c("step_database").alias("database_name"), c("command").alias("executable_command"),
        codes.step_action(c("on_success_action"), c("on_success_step_id"), c("_success_name")).alias("on_success_action"),
        "retry_attempts", "retry_interval",
        codes.step_action(c("on_fail_action"), c("on_fail_step_id"), c("_failure_name")).alias("on_failure_action"),
    )


def comparable_definitions(definitions: DataFrame, keys: Sequence[str] = (), ignored_jobs: Sequence[str] = ("",)) -> DataFrame:
    """Normalised columns used to compare definitions; ignored and unnamed jobs drop out."""
    named = definitions.filter(F.col("job_name").isNotNull() & ~F.lower("job_name").isin([j.lower() for j in ignored_jobs]))
    columns = [(F.lower(n) if text else F.col(n)).alias(n) for n, text in COMPARED.items()]
    present = F.col("executable_command").isNotNull().cast("int").alias("has_command")
    return named.select(*keys, *columns, present)


def definition_drift(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = (), ignored_jobs: Sequence[str] = ("",)
) -> DataFrame:
    """Definitions found on one side only, with the ``side`` they are on.

    Both sides are aggregated together once over all compared columns: duplicates
    fold map-side, NULLs compare equal, and one shuffle answers both directions.
    """
    a = comparable_definitions(primary, keys, ignored_jobs).withColumns({"_a": F.lit(True), "_b": F.lit(False)})
    b = comparable_definitions(secondary, keys, ignored_jobs).withColumns({"_a": F.lit(False), "_b": F.lit(True)})
    columns = [c for c in a.columns if not c.startswith("_")]
    sides = a.unionByName(b).groupBy(*columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.filter(F.col("_a") != F.col("_b")).select(
        F.when(F.col("_a"), "primary").otherwise("secondary").alias("side"), *columns
    )
