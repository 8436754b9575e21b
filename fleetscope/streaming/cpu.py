"""CPU history from a stream of health records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetscope.operators.filters import latest_only
from fleetscope.sources.cpu_records import parse_cpu_records


def stream_cpu_history(records: DataFrame, clock: DataFrame, history: DataFrame | None = None, minutes: int = 15) -> DataFrame:
    """Each record once; records older than the window, or stored in ``history``, are dropped.

    ``clock`` and ``history`` are static tables. Ids that came since the stream began are kept
    in state until the watermark passes them; ids stored before are looked up.
    """
    fresh = latest_only(parse_cpu_records(records, clock, minutes), "collection_time", minutes)
    if history is not None:
        fresh = fresh.join(history.select("server_id", "record_id"), ["server_id", "record_id"], "left_anti")
    return fresh.withWatermark("event_time", f"{minutes} minutes").dropDuplicatesWithinWatermark(["server_id", "record_id"])
