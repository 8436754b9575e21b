"""Row filters on sessions, records and replicas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FILTER_COLUMNS = {
    "program": "program_name",
    "login": "login_name",
    "host": "host_name",
    "database": "database_name",
}


def _session_test(kind: str, value: str | int) -> Column | None:
    """Test for one filter; ``None`` where the filter selects everything."""
    if value in ("", None):
        return None
    if kind == "session":
        return None if int(value) == 0 else F.col("session_id") == F.lit(int(value))
    if kind not in _FILTER_COLUMNS:
        raise ValueError(f"unknown session filter {kind!r}")
    return F.lower(_FILTER_COLUMNS[kind]).like(str(value).lower())


def filter_sessions(
    sessions: DataFrame, include: tuple[str, str | int] | None = None, exclude: tuple[str, str | int] | None = None
) -> DataFrame:
    """Keep what ``include`` matches and drop what ``exclude`` matches.

    Each filter is ``(kind, value)``: ``session`` compares the id (0 or '' means all),
    ``program``, ``login``, ``host`` and ``database`` match a ``%``/``_`` pattern.
    A NULL name matches neither filter.
    """
    if include is not None and (test := _session_test(*include)) is not None:
        sessions = sessions.filter(test)
    if exclude is not None and (test := _session_test(*exclude)) is not None:
        sessions = sessions.filter(~test)
    return sessions


def filter_interest(sessions: DataFrame, sleeping: int = 1, own: bool = False, system: bool = False) -> DataFrame:
    """Drop sessions of no interest.

    ``sleeping``: 0 drops sleeping sessions, 1 keeps those with an open transaction, 2 keeps all.
    ``own`` keeps the collector's session (``collector_session_id``), ``system`` keeps
    sessions without a client process.
    """
    awake = F.lower("status") != "sleeping"
    if sleeping == 0:
        sessions = sessions.filter(awake)
    elif sleeping == 1:
        sessions = sessions.filter(awake | (F.col("open_tran_count") > 0))
    elif sleeping != 2:
        raise ValueError("sleeping must be 0, 1 or 2")
    if not own:
        sessions = sessions.filter(F.col("session_id") != F.col("collector_session_id"))
    if not system:
        sessions = sessions.filter(F.length(F.rtrim("host_process")) > 0)
    return sessions


def latest_only(records: DataFrame, now: datetime | Column | str, minutes: int = 15, time: str = "event_time") -> DataFrame:
    """Records younger than ``minutes``. ``now`` may be a fixed time or a column."""
    at = F.col(now) if isinstance(now, str) else now if isinstance(now, Column) else F.lit(now)
    return records.filter(F.col(time) > at - F.expr(f"interval {int(minutes)} minutes"))


def unhealthy_replicas(replica_states: DataFrame) -> DataFrame:
    """Local databases whose synchronization health is not healthy."""
    return replica_states.filter(
        F.col("is_local") & F.col("synchronization_health").isin("NOT_HEALTHY", "PARTIALLY_HEALTHY")
    )


def anti_join_new_records(new: DataFrame, history: DataFrame) -> DataFrame:
    """Records whose id is not stored yet for their server."""
    return new.join(history.select("server_id", "record_id"), ["server_id", "record_id"], "left_anti")


def top_recent_records(records: DataFrame, count: int = 15) -> DataFrame:
    """Newest ``count`` records of every server.

    The rank filter is applied before the shuffle as well, so a busy server sends at
    most ``count`` rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy("server_id").orderBy(F.col("record_id").desc()))
    return records.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")


def expand_blockers_or_all(procs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Processes named in ``wanted``, or every process of a collection whose marker row 0 is present.

    ``is_blocker`` tells whether the process was named itself.
    """
    at = ["server_id", "collection_time"]
    named = wanted.filter("session_id <> 0").select(*at, "session_id").distinct().withColumn("_named", F.lit(True))
    whole = wanted.filter("session_id = 0").select(*at).distinct().withColumn("_whole", F.lit(True))
    return (
        procs.join(named, [*at, "session_id"], "left").join(whole, at, "left")
        .filter(F.col("_named").isNotNull() | F.col("_whole").isNotNull())
        .withColumn("is_blocker", F.col("_named").isNotNull())
        .drop("_named", "_whole")
    )
