"""CPU health records kept as small XML texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.locktext import first_group
from fleetscope.functions.semantics import add_ms
from fleetscope.keys import K


def parse_cpu_records(records: DataFrame, clock: DataFrame, minutes: int | None = None) -> DataFrame:
    """Record id, idle, process and other CPU percent, and the time of each record.

    ``clock`` gives the tick count of each collection. With ``minutes`` set, old records
    are dropped by their tick before any text is parsed. Malformed values become NULL
    instead of failing the scan.
    """
    timed = records.filter(F.contains("record", F.lit("<SystemHealth>"))).join(clock, K)
    age = F.col("ms_ticks") - F.col("ts_ticks")
    if minutes is not None:
        timed = timed.filter(age < minutes * 60_000)
    number = {
        "record_id": r"<Record\b[^>]*?\bid\s*=\s*[\"']\s*(\d+)",
        "system_idle": r"<SystemIdle>\s*(-?\d+)",
        "sql_process": r"<ProcessUtilization>\s*(-?\d+)",
    }
    parsed = timed.select(
        *K, add_ms(F.col("collection_time"), -age).alias("event_time"),
        *[first_group(F.col("record"), pattern).try_cast("bigint").alias(name) for name, pattern in number.items()],
    )
    return parsed.withColumn("other_process", 100 - F.col("system_idle") - F.col("sql_process"))
