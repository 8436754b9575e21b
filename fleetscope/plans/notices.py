"""Jobs that end in a notification."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import alerts, filters, replicas
from fleetscope.sinks.outbox import outbox_enqueue
from fleetscope.sinks.report import report_document


def sync_check(databases: DataFrame, replica_states: DataFrame, ignored: DataFrame) -> DataFrame:
    """A notice per server that has unsynchronised databases."""
    rows = replicas.unsynced_databases(databases, replica_states, ignored).select("server_id", "name").distinct()
    heading = F.concat(F.lit("<h3>Unsynchronised Databases - "), F.col("server_id").cast("string"), F.lit("</h3>"))
    pages = report_document(rows, ["server_id"], {"name": "DatabaseName"}, [F.col("name")], heading)
    return pages.select(
        "server_id", "page_no", F.concat(F.lit("Unsynchronised Databases - "), F.col("server_id").cast("string")).alias("mail_subject"),
        F.col("body").alias("mail_body"),
    )


def replica_health_report(replica_states: DataFrame, databases: DataFrame, roles: DataFrame) -> DataFrame:
    """A notice per server with databases whose replica is not healthy."""
    names = databases.select("server_id", "collection_time", "database_id", "name")
    rows = filters.unhealthy_replicas(replica_states).join(names, ["server_id", "collection_time", "database_id"], "left")
    titles = {
        "name": "Database Name", "synchronization_state": "Synchronization State",
        "synchronization_health": "Synchronization Health", "database_state": "Database State",
    }
    order = [F.col("database_id"), F.col("collection_time")]
    pages = report_document(rows, ["server_id"], titles, order).join(roles, "server_id", "left")
    lead = F.concat(
        F.lit("Server "), F.col("server_id").cast("string"), F.lit(" is the "), F.coalesce("role", F.lit("N/A")),
        F.lit(" member of "), F.coalesce("group_name", F.lit("N/A")), F.lit(": "),
    )
    return pages.select(
        "server_id", "page_no", F.concat(F.lit("Availability Group Health Alert For "), F.col("server_id").cast("string")).alias("mail_subject"),
        F.concat(lead, F.col("body")).alias("mail_body"),
    )


def drift_notices(drift: DataFrame) -> DataFrame:
    """One notice per secondary whose definitions differ from its primary's."""
    server = F.col("secondary_id").cast("string")
    subject = F.concat(F.lit("Agent job definitions differ between Primary and Secondary. Current secondary: "), server)
    return drift.groupBy(F.col("secondary_id")).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("secondary_id").alias("server_id"), subject.alias("mail_subject"),
        F.concat(F.lit("Differing definitions: "), F.col("_n").cast("string")).alias("mail_body"),
    )


def alert_notices(events: DataFrame, now: datetime, seconds: int = alerts.COOLDOWN_SECONDS) -> DataFrame:
    """Notifications for alerts that fire."""
    fired = alerts.cooldown_alerts(events, seconds)
    return outbox_enqueue(
        fired.select(
            "server_id", F.concat(F.col("rule"), F.lit(" on server "), F.col("server_id").cast("string")).alias("mail_subject"),
            F.concat_ws(" ", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("message")).alias("mail_body"),
        ), now,
    )
