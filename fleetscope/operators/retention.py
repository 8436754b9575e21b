"""Retention cuts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days of history kept per table.
RETENTION_DAYS = {
    "cpu_usage": 31,
    "job_definitions": 30,
    "job_enabled_status": 100,
    "space": 365,
    "temp_space": 30,
    "sessions": 30,
    "command_log": 30,
    "backup_history": 30,
    "job_history": 30,
}

# Tables whose cut is an instant; the others keep the whole boundary day.
INSTANT_TABLES = ("sessions", "command_log")


def retained(time: Column, now: datetime, days: int, grain: str) -> Column:
    """True for rows inside the retention window.

    ``date`` compares calendar days, so the whole boundary day stays; ``timestamp``
    compares instants. Rows without a time stay.
    """
    boundary = now - timedelta(days=days)
    if grain == "date":
        # Midnight of the boundary day: the same cut, and it reaches the file scan.
        keep = time >= F.lit(datetime.combine(boundary.date(), datetime.min.time()))
    elif grain == "timestamp":
        keep = time >= F.lit(boundary)
    else:
        raise ValueError("grain must be 'date' or 'timestamp'")
    return keep | time.isNull()


def purge_history(df: DataFrame, time: str, days: int, grain: str, now: datetime) -> DataFrame:
    return df.filter(retained(F.col(time), now, days, grain))
