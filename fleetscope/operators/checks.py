"""Integrity-check eligibility and the outcome of logged commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import boundaries_between, int_div
from fleetscope.operators.backup_rules import first_reason
from fleetscope.sources.selectors import selector_items

# Error numbers of deadlock and lock timeout.
LOCK_ERRORS = (1205, 1222)


def integrity_check_eligibility(databases: DataFrame) -> DataFrame:
    """Add ``skip_reason`` per database and policy; NULL where checks may run.

    Policy columns: ``replica_scope`` (ALL, PRIMARY, SECONDARY, PREFERRED_BACKUP_REPLICA),
    ``updateability`` and ``checks_secondaries`` (edition allows checks off the primary).
    ``may_check_objects`` also needs a primary or a readable secondary.
    """
    c = F.col
    role, scope = c("replica_role"), c("replica_scope")
    at_role = (
        ((scope == "PRIMARY") & (role == "PRIMARY")) | ((scope == "SECONDARY") & (role == "SECONDARY"))
        | ((scope == "PREFERRED_BACKUP_REPLICA") & F.coalesce(c("is_preferred_replica"), F.lit(False)))
        | (scope == "ALL") | role.isNull()
    )
    reasons = {
        "not online": ~c("state").isin("ONLINE", "EMERGENCY"),
        "single user and not accessible": (c("user_access") == "SINGLE_USER") & ~c("is_accessible"),
        "edition checks the primary only": ~(role.isNull() | (role == "PRIMARY") | c("checks_secondaries")),
        "other replica role wanted": ~at_role,
        "read-only database": c("is_read_only") & (c("updateability") == "READ_WRITE"),
        "read-write database": ~c("is_read_only") & (c("updateability") == "READ_ONLY"),
    }
    readable = role.isNull() | (role == "PRIMARY") | ((role == "SECONDARY") & (c("secondary_connections") == "ALL"))
    out = databases.withColumn("skip_reason", first_reason(reasons))
    return out.withColumn("may_check_objects", F.col("skip_reason").isNull() & F.coalesce(readable, F.lit(False)))


def expand_check_commands(planned: DataFrame, delimiter: str = ",") -> DataFrame:
    """One row per check command of the policy; object-level commands need object access."""
    commands = planned.withColumn("check_command", F.explode(selector_items(F.col("check_commands"), delimiter)))
    whole = F.col("check_command").isin("CHECKDB", "CHECKFILEGROUP", "CHECKALLOC", "CHECKCATALOG")
    return commands.filter(whole | F.col("may_check_objects"))


def last_success(command_log: DataFrame, command_type: str) -> DataFrame:
    """Last start of a command type that ended without error, per database."""
    return (
        command_log.filter((F.col("command_type") == command_type) & (F.col("error_number") == 0))
        .groupBy("server_id", "database_name").agg(F.max("start_time").alias("last_command_time"))
    )


def command_outcomes(command_log: DataFrame, lock_message_severity: int = 16) -> DataFrame:
    """Outcome, duration and severity of each logged command.

    A command without an error number was not executed. Deadlocks and lock timeouts
    take ``lock_message_severity``; at 10 they do not fail the run.
    """
    if lock_message_severity not in (10, 16):
        raise ValueError("lock_message_severity must be 10 or 16")
    error = F.col("error_number")
    seconds = boundaries_between("second", F.col("start_time"), F.col("end_time"))
    days = int_div(seconds, 86400)
    clock = F.concat_ws(
        ":", *[F.lpad(part.cast("string"), 2, "0") for part in (
            int_div(seconds % 86400, 3600), int_div(seconds % 3600, 60), seconds % 60,
        )]
    )
    text = F.concat(F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit("")), clock)
    lock_error = error.isin(*LOCK_ERRORS)
    severity = F.when(error == 0, F.lit(None)).when(lock_error, lock_message_severity).when(error.isNotNull(), 16)
    return command_log.withColumns({
        "outcome": F.when(error.isNull(), "Not Executed").when(error == 0, "Succeeded").otherwise("Failed"),
        "duration_seconds": seconds,
        "duration": F.when(seconds.isNotNull(), text),
        "severity": severity.cast("int"),
        "return_code": F.when(lock_error & F.lit(lock_message_severity == 10), 0).otherwise(F.coalesce(error, F.lit(0))),
    })
