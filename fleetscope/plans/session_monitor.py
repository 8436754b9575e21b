"""The session monitor: one report row per request and collection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import int_div, ms_between
from fleetscope.functions.statements import active_statement, last_request_start, request_start_time
from fleetscope.functions.waittext import wait_detail, wait_text
from fleetscope.keys import K, SK
from fleetscope.operators import deltas, filters, graph, locks, sessions, usage, waits
from fleetscope.operators.ranking import null_safe_join
from fleetscope.runtime import freeze

# Column groups that are joined only where asked for.
GROUPS = (
    "tasks", "tempdb", "transactions", "average", "blocking", "locks", "text", "jobs", "deltas", "memory", "options", "blocked_objects",
)


def session_snapshot(
    inputs: Mapping[str, DataFrame], groups: tuple[str, ...] = ("tempdb", "blocking"),
    include: tuple[str, str] | None = None, exclude: tuple[str, str] | None = None,
    sleeping: int = 1, own: bool = True, system: bool = False,
) -> DataFrame:
    """Sessions of interest with state, waits, reads, writes and times.

    ``inputs`` maps relation names to DataFrames; ``procs``, ``sessions``, ``requests`` and
    ``databases`` are always read, others only for the groups asked for. Sessions that block a
    selected one come along (``is_added``). The request rows feed several joins, so they
    are written once to the shared folder instead of being computed for each. With
    ``locks`` a request has one row per page of its lock document; ``blocked_objects`` needs ``tasks``.
    """
    unknown = set(groups) - set(GROUPS)
    if unknown:
        raise ValueError(f"unknown column groups {sorted(unknown)}")
    if "blocked_objects" in groups and "tasks" not in groups:
        raise ValueError("blocked_objects needs the waits of tasks")
    names = inputs["databases"].select(*K, "database_id", F.col("name").alias("database_name"))
    everything = sessions.one_row_per_request(inputs["procs"]).join(names, [*K, "database_id"], "left")
    everything = freeze(everything.withColumn("blocking_session_id", F.nullif(F.col("blocked"), F.lit(0))))
    kept = filters.filter_sessions(everything, include, exclude)
    if not own:
        kept = kept.join(
            inputs["collectors"].withColumnRenamed("collector_session_id", "session_id"), [*K, "session_id"], "left_anti"
        )
    kept = filters.filter_interest(kept, sleeping, own=True, system=system)
    chosen = graph.blocker_closure(kept, everything)
    live = _with_times(sessions.session_request_join(chosen, inputs["sessions"], inputs["requests"]))
    out = live.withColumn("wait_info", _own_wait())
    for group in GROUPS:
        if group in groups:
            out = _ADD[group](out, everything, inputs)
    return out.withColumn("elapsed_ms", ms_between(F.col("start_time"), F.col("collection_time")))


def _own_wait() -> Column:
    detail = wait_detail(F.col("wait_type"), F.col("wait_resource"), F.col("database_name"))
    return wait_text(F.col("wait_time"), F.col("wait_type"), detail)


def _with_times(df: DataFrame) -> DataFrame:
    is_user, elapsed = F.col("session_is_user"), F.col("request_elapsed_ms")
    return df.withColumns({
        "start_time": request_start_time(
            is_user, elapsed, F.col("request_start"), F.col("last_request_end_time"), F.col("login_time"), F.col("collection_time")
        ),
        "last_request_start_time": last_request_start(is_user, elapsed, F.col("session_request_start"), F.col("collection_time")),
        "used_memory": F.col("memory_usage") + F.col("granted_query_memory"),
    })


def _tasks(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    tasks = freeze(waits.active_tasks(inputs["tasks"], inputs["workers"], inputs["threads"], everything))
    texts = waits.session_waits(inputs["waiting_tasks"], everything, inputs["databases"])
    summary = waits.task_summary(waits.rank_waits(waits.wait_profile(tasks, texts)))
    summary = summary.withColumnRenamed("wait_info", "_task_waits")
    joined = out.join(summary, SK, "left")
    waiting = F.coalesce(F.nullif(F.col("_task_waits"), F.lit("")), F.col("wait_info"))
    return joined.withColumn("wait_info", waiting).drop("_task_waits")


def _tempdb(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    used = usage.tempdb_usage(inputs["task_space"], inputs["session_space"], everything)
    used = used.withColumnRenamed("request_id", "_space_request")
    at = out.withColumn("_space_request", F.when(F.col("status") == "sleeping", F.lit(-1)).otherwise(F.col("request_id")))
    joined = at.join(used, [*K, "session_id", "_space_request"], "left").drop("_space_request")
    return joined.fillna(0, ["tempdb_allocations", "tempdb_current"])


def _transactions(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    owners = out.select(*SK, "transaction_id")
    log = usage.transaction_log_usage(inputs["active_tx"], inputs["db_tx"], inputs["session_tx"], owners)
    names = inputs["databases"].select(*K, "database_id", F.col("name").alias("database_name"))
    text = usage.transaction_text(usage.rank_transactions(log).join(names, [*K, "database_id"], "left"))
    return out.join(text, SK, "left")


def _average(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    shaped = out.select(
        *SK, F.col("active_sql_handle").alias("sql_handle"), "plan_handle",
        F.col("active_stmt_start").alias("stmt_start"), F.col("active_stmt_end").alias("stmt_end"),
    )
    return out.join(sessions.average_runtime(shaped, inputs["query_stats"]).select(*SK, "avg_elapsed_ms"), SK, "left")


def _blocking(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return out.join(graph.blocking_chains(everything), [*K, "session_id"], "left")


def _locks(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    held = locks.session_locks(out.select(*SK, "start_time"), locks.lock_inventory(inputs["locks"])).drop("start_time")
    named = locks.resolve_object_names(
        held, *[inputs[n] for n in ("alloc_units", "partitions", "objects", "indexes", "schemas", "principals")]
    )
    pages = locks.lock_document(named).withColumnsRenamed({"databases": "locks", "page_no": "lock_page_no"})
    return out.join(pages, SK, "left")


def _text(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    texts = inputs["sql_text"].select("server_id", F.col("sql_handle").alias("active_sql_handle"), F.col("text").alias("_text"))
    joined = null_safe_join(out, texts, ["server_id", "active_sql_handle"], "left")
    cut = active_statement(F.col("_text"), F.col("active_stmt_start"), F.col("active_stmt_end"))
    return joined.withColumn("sql_text", cut).drop("_text")


def _jobs(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    return usage.agent_job_names(out, inputs["jobs"], inputs["steps"])


def _deltas(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    metrics = [m for m in deltas.METRICS if m in inputs["snapshots"].columns]
    changed = deltas.session_deltas(inputs["snapshots"], metrics)
    return out.join(changed.select(*SK, *[c for c in changed.columns if c.endswith("_delta")]), SK, "left")


def _memory(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Pages of 8 KB of the request's memory grant; what a grant uses replaces the session's own figure."""
    pages = {f"_{c}": int_div(F.col(f"{c}_memory_kb"), 8) for c in ("requested", "granted", "used", "max_used")}
    grants = inputs["memory_grants"].select(*SK, *[column.alias(name) for name, column in pages.items()])
    return out.join(grants, SK, "left").withColumn("used_memory", F.coalesce("_used", "used_memory")).drop("_used").withColumnsRenamed(
        {"_max_used": "max_used_memory", "_requested": "requested_memory", "_granted": "granted_memory"}
    )


SETTINGS = ("text_size", "language", "date_format", "date_first", "lock_timeout", "deadlock_priority", "row_count")


def _options(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """``additional_info``: the session's settings, switches as ON or OFF, and its isolation level by name."""
    told = sessions.session_options(inputs["session_options"])
    known = told.select(*K, "session_id", F.struct(*SETTINGS, *sessions.SWITCHES, "transaction_isolation_level").alias("additional_info"))
    return out.join(known, [*K, "session_id"], "left")


def _blocked_objects(out: DataFrame, everything: DataFrame, inputs: Mapping[str, DataFrame]) -> DataFrame:
    blocked = out.filter("block_text is not null").select(*SK, "block_text")
    names = inputs["databases"].select("server_id", "database_id", "name").distinct()
    found = waits.blocked_object_names(blocked, names, *[inputs[n] for n in ("partitions", "objects", "schemas")])
    columns = ["lock_type", "database_name", "hobt_id", "schema_name", "object_name"]
    return out.join(found.select(*SK, F.struct(*columns).alias("blocked_object")), SK, "left")


_ADD = {
    "tasks": _tasks, "tempdb": _tempdb, "transactions": _transactions, "average": _average, "blocking": _blocking,
    "locks": _locks, "text": _text, "jobs": _jobs, "deltas": _deltas,
    "memory": _memory, "options": _options, "blocked_objects": _blocked_objects,
}


def order_output(report: DataFrame, *columns: str) -> DataFrame:
    """Order the report, by start time where nothing else is asked; a leading ``-`` sorts descending."""
    wanted = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in columns or ("start_time",)]
    return report.orderBy(*wanted, *[F.col(c) for c in SK])
