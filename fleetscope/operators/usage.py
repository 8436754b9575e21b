"""Temp space, transaction log and agent-job attribution of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import int_div, scrub_control
from fleetscope.functions.statements import job_id_from_program, job_step_from_program
from fleetscope.keys import K, SK
from fleetscope.operators.ranking import number_rows

# Fixed value: database ids from here on are internal.
INTERNAL_DATABASE_ID = 32767


def tempdb_usage(task_space: DataFrame, session_space: DataFrame, sessions: DataFrame) -> DataFrame:
    """Temp-space pages allocated and still held, per request.

    Space of the session itself carries request -1, which is where a sleeping session
    finds it. A negative current amount shows as 0.
    """
    def pages(df: DataFrame, request) -> DataFrame:
        allocated = F.col("user_objects_alloc_page_count") + F.col("internal_objects_alloc_page_count")
        freed = F.col("user_objects_dealloc_page_count") + F.col("internal_objects_dealloc_page_count")
        return df.select(
            *K, "session_id", request.cast("bigint").alias("request_id"),
            allocated.alias("tempdb_allocations"), (allocated - freed).alias("tempdb_current"),
        )

    used = pages(task_space, F.coalesce("request_id", F.lit(-1))).unionByName(pages(session_space, F.lit(-1)))
    return (
        used.join(sessions.select(*K, "session_id").distinct(), [*K, "session_id"], "left_semi")
        .groupBy(*SK)
        .agg(
            F.coalesce(F.sum("tempdb_allocations"), F.lit(0)).alias("tempdb_allocations"),
            F.greatest(F.coalesce(F.sum("tempdb_current"), F.lit(0)), F.lit(0)).alias("tempdb_current"),
        )
    )


def transaction_log_usage(active_tx: DataFrame, db_tx: DataFrame, session_tx: DataFrame, sessions: DataFrame) -> DataFrame:
    """Log records and KB written per request and database, with the earliest begin time.

    A transaction belongs to the session that runs it, else to the session bound to
    it; of several requests the lowest wins. Transactions begun after the collection
    and internal databases do not count.
    """
    started = active_tx.filter(F.col("transaction_begin_time") <= F.col("collection_time")).select(
        *K, "transaction_id", (F.col("name") == "implicit_transaction").cast("int").alias("_implicit")
    )
    work = db_tx.filter(F.col("database_id") < INTERNAL_DATABASE_ID).join(started, [*K, "transaction_id"])
    owner = F.min(F.struct("request_id", "session_id"))
    running = sessions.filter("transaction_id is not null").groupBy(*K, "transaction_id").agg(owner.alias("_running"))
    bound = sessions.groupBy(*K, F.col("session_id").alias("_bound_session")).agg(owner.alias("_bound"))
    binding = session_tx.select(*K, "transaction_id", F.col("session_id").alias("_bound_session"))
    mapped = (
        work.join(binding, [*K, "transaction_id"], "left")
        .join(running, [*K, "transaction_id"], "left")
        .join(bound, [*K, "_bound_session"], "left")
        .withColumn("_owner", F.least("_running", "_bound"))
        .filter("_owner is not null")
    )
    return mapped.groupBy(
        *K, F.col("_owner.session_id").alias("session_id"), F.col("_owner.request_id").alias("request_id"), "database_id"
    ).agg(
        F.coalesce(F.sum("log_record_count"), F.lit(0)).alias("log_record_count"),
        int_div(F.coalesce(F.sum("log_bytes_used"), F.lit(0)), 1024).alias("log_kb_used"),
        F.min("begin_time").alias("transaction_start_time"),
        (F.coalesce(F.max("_implicit"), F.lit(0)) == 1).alias("implicit_tran"),
    )


def rank_transactions(usage: DataFrame) -> DataFrame:
    """Newest transaction first within each request; a server has a bounded number of databases."""
    order = [F.col("transaction_start_time").desc_nulls_last(), F.col("database_id").asc_nulls_first()]
    return number_rows(usage, SK, order, "tran_rank", bounded=True)


def transaction_text(ranked: DataFrame) -> DataFrame:
    """Start of the newest transaction and ``database: n (k kB),`` for each, newest first.

    ``ranked`` carries ``database_name`` beside the columns of ``rank_transactions``.
    """
    name = scrub_control(F.coalesce("database_name", F.lit("(null)")))
    entry = F.concat(
        name, F.lit(": "), F.col("log_record_count").cast("string"), F.lit(" ("), F.col("log_kb_used").cast("string"), F.lit(" kB),")
    )
    return ranked.withColumn("_text", entry).groupBy(*SK).agg(
        F.max(F.when(F.col("tran_rank") == 1, F.col("transaction_start_time"))).alias("tran_start_time"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("tran_rank", "_text"))), lambda t: t["_text"]), ""
        ).alias("tran_log_writes"),
        F.max(F.when(F.col("tran_rank") == 1, F.col("implicit_tran"))).alias("implicit_tran"),
    )


def agent_job_names(sessions: DataFrame, jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Job and step that a session runs, read from its program name."""
    parsed = sessions.withColumn("job_id", job_id_from_program(F.col("program_name"))).withColumn(
        "step_id", job_step_from_program(F.col("program_name"))
    )
    named = (
        jobs.select("server_id", "job_id", F.col("name").alias("job_name"))
        .join(steps.select("server_id", "job_id", "step_id", "step_name"), ["server_id", "job_id"])
        .select(
            "server_id", F.upper("job_id").alias("job_id"), F.col("step_id").cast("bigint").alias("step_id"),
            scrub_control(F.col("job_name")).alias("job_name"), scrub_control(F.col("step_name")).alias("step_name"),
        )
    )
    return parsed.join(named, ["server_id", "job_id", "step_id"], "left")
