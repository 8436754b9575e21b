"""Notifications as append-only rows; delivery is a second append-only table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outbox_enqueue(notices: DataFrame, now: datetime, recipients: str = "", copies: str = "", mail_format: str = "HTML") -> DataFrame:
    """Notification rows for ``server_id``, ``mail_subject`` and ``mail_body``.

    The id is derived from the content, so a replayed batch makes the same rows.
    """
    rows = notices.select(
        "server_id", "mail_body", F.lit(mail_format).alias("mail_format"), "mail_subject",
        F.lit(recipients).alias("mail_recipients"), F.lit(copies).alias("cc_recipients"), F.lit(now).alias("mail_requested"),
    )
    identity = F.sha2(F.to_json(F.struct("server_id", "mail_subject", "mail_body", "mail_requested")), 256)
    return rows.withColumn("notification_id", identity)


def outbox_ack(attempts: DataFrame) -> DataFrame:
    """First successful delivery per notification; a failed attempt (state not 0) does not count."""
    return attempts.filter("mail_state = 0").groupBy("notification_id").agg(F.min("attempted_at").alias("mail_delivered"))


def outbox_state(notices: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every notification once, with whether and when it was delivered."""
    return (
        notices.dropDuplicates(["notification_id"]).join(outbox_ack(attempts), "notification_id", "left")
        .withColumn("delivered", F.col("mail_delivered").isNotNull())
    )


def outbox_pending(notices: DataFrame, attempts: DataFrame) -> DataFrame:
    """Notifications still to be delivered."""
    done = outbox_ack(attempts).select("notification_id")
    return notices.dropDuplicates(["notification_id"]).join(done, "notification_id", "left_anti")
