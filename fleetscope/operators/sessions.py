"""From raw threads to one row per request, and the joins that enrich it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import codes
from fleetscope.functions.semantics import int_div
from fleetscope.functions.waittext import PARALLEL_WAITS, is_lock_wait, keeps_resource, without_latch_note
from fleetscope.keys import K, SK
from fleetscope.operators.ranking import best_row, dense_number, spread_group_value

_ROLLUP_MAX = {
    "login_time": "login_time",
    "last_request_end_time": "last_batch",
    "stmt_start": "stmt_start",
    "stmt_end": "stmt_end",
    "sql_handle": "sql_handle",
    "database_id": "database_id",
    "memory_usage": "memory_usage",
    "open_tran_count": "open_tran",
}
_ROLLUP_TEXT = ["status", "cmd", "host_name", "login_name", "program_name", "host_process"]


def request_number(status: Column, request_id: Column) -> Column:
    """Sleeping sessions have one request, number 0."""
    return F.when(F.rtrim(status) == "sleeping", F.lit(0)).otherwise(request_id)


def session_rollup(procs: DataFrame) -> DataFrame:
    """Threads to one row per (request, wait type, wait resource, blocker).

    A session that blocks itself counts as not blocked. ``is_user_process`` is true
    where any thread has a client process.
    """
    shaped = procs.select(
        *K, "session_id",
        request_number(F.col("status"), F.col("request_id")).alias("request_id"),
        F.rtrim("wait_type").alias("wait_type"),
        without_latch_note(F.col("wait_resource")).alias("wait_resource"),
        F.coalesce(F.nullif(F.col("blocked"), F.col("session_id")), F.lit(0)).alias("blocked"),
        "wait_time",
        *[F.col(source).alias(name) for name, source in _ROLLUP_MAX.items()],
        *[F.rtrim(c).alias(c) for c in _ROLLUP_TEXT],
    )
    return shaped.groupBy(*SK, "wait_type", "wait_resource", "blocked").agg(
        F.max("wait_time").alias("wait_time"),
        *[F.max(c).alias(c) for c in [*_ROLLUP_MAX, *_ROLLUP_TEXT]],
        F.coalesce(F.max(F.length("host_process") > 0), F.lit(False)).alias("is_user_process"),
    )


def fill_session(rollup: DataFrame) -> DataFrame:
    """Spread handle, login, memory and open transactions over all rows of a request."""
    return spread_group_value(
        rollup, SK,
        sql_handle=F.max("sql_handle"), login_name=F.max("login_name"),
        memory_usage=F.max("memory_usage"), open_tran_count=F.max("open_tran_count"),
    )


def effective_waits(rollup: DataFrame) -> DataFrame:
    """Blank out waits that say nothing: parallel exchanges and waits of no length."""
    own = ~F.col("wait_type").isin(*PARALLEL_WAITS)
    real = (F.col("wait_time") > 0) & own
    return rollup.withColumns({
        "status": F.lower("status"),
        "stmt_start": F.when(F.col("cmd") == "CREATE INDEX", 0).otherwise(F.col("stmt_start")),
        "stmt_end": F.when(F.col("cmd") == "CREATE INDEX", -1).otherwise(
            F.coalesce(F.nullif(F.col("stmt_end"), F.lit(0)), F.lit(-1))
        ),
        "wait_type": F.when(real, F.col("wait_type")),
        "wait_resource": F.when(real, F.col("wait_resource")),
        "wait_time": F.when(own, F.col("wait_time")).otherwise(F.lit(0)),
    })


_FILLED = ["sql_handle", "login_name", "memory_usage", "open_tran_count"]


def _primary_order() -> list[Column]:
    lock_first = F.coalesce(is_lock_wait(F.col("wait_type")).cast("int"), F.lit(0))
    ties = ["wait_type", "wait_resource", "last_request_end_time", "stmt_start", "stmt_end", "cmd", "program_name"]
    return [lock_first, F.col("wait_time"), F.col("blocked"), *[F.col(c) for c in ties]]


def primary_wait(waits: DataFrame) -> DataFrame:
    """One row per request: lock waits first, then the longest wait, then the highest blocker.

    Remaining ties go to the greater wait type and resource, then to the latest batch and
    statement. The resource is kept only for wait types it explains.
    """
    best = best_row(waits, SK, _primary_order(), [c for c in waits.columns if c not in SK])
    return best.withColumn("wait_resource", F.when(keeps_resource(F.col("wait_type")), F.col("wait_resource")))


def one_row_per_request(procs: DataFrame) -> DataFrame:
    """Rollup, spread and primary wait in one pass.

    The values ``fill_session`` would spread are taken in the same aggregate that picks the
    row, so the processes are scanned and shuffled once.
    """
    waits = effective_waits(session_rollup(procs))
    rest = [c for c in waits.columns if c not in (*SK, *_FILLED)]
    best = best_row(waits, SK, _primary_order(), rest, {c: F.max(c) for c in _FILLED})
    return best.withColumn("wait_resource", F.when(keeps_resource(F.col("wait_type")), F.col("wait_resource")))


def session_number(sessions: DataFrame) -> DataFrame:
    """Consecutive number of the session id within its collection."""
    return dense_number(sessions, K, "session_id", "session_number")


def session_request_join(procs: DataFrame, sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach the live session (same login) and its current request (not while sleeping).

    The request must belong to the sampled one: both are system sessions, or it began
    when the session's last request began and nothing finished after the sample.
    """
    p, s, r = procs.alias("p"), sessions.alias("s"), requests.alias("r")
    same_session = _equal("p", "s", [*K, "session_id", "login_time"])
    system = ~F.col("s.is_user_process") & ~F.col("p.is_user_process")
    current = (F.col("r.start_time") == F.col("s.last_request_start_time")) & (
        F.col("s.last_request_end_time") <= F.col("p.last_request_end_time")
    )
    same_request = _equal("p", "r", SK) & (F.col("p.status") != "sleeping") & (system | current)
    measures = ["logical_reads", "reads", "writes", "cpu_time"]
    return (
        p.join(s, same_session, "left").join(r, same_request, "left")
        .select(
            "p.*",
            *[F.coalesce(F.col(f"r.{m}"), F.col(f"s.{m}")).alias(m) for m in measures],
            F.col("s.is_user_process").alias("session_is_user"),
            F.col("s.last_request_start_time").alias("session_request_start"),
            F.col("r.start_time").alias("request_start"),
            F.col("r.total_elapsed_time").alias("request_elapsed_ms"),
            F.col("r.plan_handle").alias("plan_handle"),
            F.coalesce(F.col("r.sql_handle"), F.col("p.sql_handle")).alias("active_sql_handle"),
            F.coalesce(F.col("r.stmt_start"), F.col("p.stmt_start")).alias("active_stmt_start"),
            F.coalesce(F.col("r.stmt_end"), F.col("p.stmt_end")).alias("active_stmt_end"),
            F.col("r.transaction_id").alias("transaction_id"),
            F.coalesce(F.col("r.granted_query_memory"), F.lit(0)).alias("granted_query_memory"),
            F.nullif(F.col("r.percent_complete"), F.lit(0.0)).alias("percent_complete"),
        )
    )


def _equal(left: str, right: str, columns: list[str]) -> Column:
    test = None
    for c in columns:
        pair = F.col(f"{left}.{c}") == F.col(f"{right}.{c}")
        test = pair if test is None else test & pair
    return test


# Session switches that are stored as 0 or 1.
SWITCHES = [
    "quoted_identifier", "arithabort", "ansi_null_dflt_on", "ansi_defaults", "ansi_warnings", "ansi_padding", "ansi_nulls",
    "concat_null_yields_null",
]


def session_options(sessions: DataFrame) -> DataFrame:
    """Session switches as ON and OFF and the isolation level by name; absent columns are left out."""
    present = {c: codes.decode(F.col(c), codes.ON_OFF) for c in SWITCHES if c in sessions.columns}
    if "transaction_isolation_level" in sessions.columns:
        present["transaction_isolation_level"] = codes.decode(F.col("transaction_isolation_level"), codes.ISOLATION_LEVELS)
    return sessions.withColumns(present)


def memory_grant_chain(
    sessions: DataFrame, grants: DataFrame, semaphores: DataFrame, groups: DataFrame, pools: DataFrame
) -> DataFrame:
    """Memory grant of each request with its semaphore, workload group and resource pool."""
    return (
        sessions.join(grants, SK, "left")
        .join(semaphores, [*K, "pool_id", "resource_semaphore_id"], "left")
        .join(groups, [*K, "group_id"], "left")
        .join(pools.withColumnRenamed("pool_id", "group_pool_id"), [*K, "group_pool_id"], "left")
    )


def average_runtime(sessions: DataFrame, query_stats: DataFrame) -> DataFrame:
    """Average elapsed time of the running statement in ms, from whole microseconds."""
    keys = ["server_id", "sql_handle", "plan_handle", "stmt_start", "stmt_end"]
    stats = query_stats.select(
        *keys, int_div(F.col("total_elapsed_time"), F.col("execution_count")).alias("avg_elapsed_us")
    )
    return sessions.join(stats, keys, "left").withColumn(
        "avg_elapsed_ms", int_div(F.col("avg_elapsed_us"), 1000)
    ).drop("avg_elapsed_us")


def top1_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], best_by: list[Column], columns: list[str], how: str = "inner") -> DataFrame:
    """Attach the best matching lookup row; ``how="left"`` keeps facts without one."""
    return facts.join(best_row(lookup, keys, best_by, columns), keys, how)


def update_from(target: DataFrame, patch: DataFrame, keys: list[str], columns: list[str], best_by: list[Column]) -> DataFrame:
    """Patch columns from matching rows; the greatest ``best_by`` wins where several match."""
    chosen = best_row(patch, keys, best_by, columns).withColumnsRenamed({c: f"_new_{c}" for c in columns})
    joined = target.join(chosen, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])
