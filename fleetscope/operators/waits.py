"""Task totals and wait profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.locktext import block_info, metadata_schema_id
from fleetscope.functions.semantics import int_div
from fleetscope.functions.waittext import is_lock_wait, wait_detail, wait_group_text, without_latch_note
from fleetscope.keys import K, SK
from fleetscope.operators.ranking import best_row, null_safe_join, number_small_groups, spread_group_value
from fleetscope.runtime import cut_lineage, freeze

RUNNABLE = "RUNNABLE"
_TOTALS = ["physical_io", "context_switches", "thread_cpu", "tasks"]


def active_tasks(tasks: DataFrame, workers: DataFrame, threads: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tasks of sessions that are not sleeping, with runnable time and thread CPU."""
    awake = sessions.filter("status <> 'sleeping'").select(*SK).distinct()
    runnable = (F.col("task_state") == RUNNABLE) & (F.col("runnable_time") > 0)
    return (
        tasks.join(awake, SK, "left_semi")
        .join(workers.select(*K, "worker_address", "thread_address", "runnable_time"), [*K, "worker_address"], "left")
        .join(
            threads.select(*K, "thread_address", (F.col("usermode_time") + F.col("kernel_time")).alias("thread_cpu_time")),
            [*K, "thread_address"], "left",
        )
        .withColumn("runnable_time", F.when(runnable, F.col("runnable_time")))
    )


def task_totals(tasks: DataFrame) -> DataFrame:
    """I/O, switches, thread CPU and task count of the whole request on every task row."""
    return spread_group_value(
        tasks, SK,
        physical_io=F.sum("pending_io_count"), context_switches=F.sum("context_switches_count"),
        thread_cpu=F.sum("thread_cpu_time"), tasks=F.count(F.lit(1)),
    )


def session_waits(waiting_tasks: DataFrame, sessions: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Distinct waits of collected sessions, one row per waiting task and wait text.

    ``block_text`` is the resource of a lock wait whose blocker is also the session's
    own blocker.
    """
    first = best_row(sessions, [*K, "session_id"], [F.col("request_id"), F.col("blocked")], ["blocked", "wait_type"])
    first = first.withColumnsRenamed({"blocked": "_blocked", "wait_type": "_session_wait"})
    joined = waiting_tasks.join(first, [*K, "session_id"]).filter(
        (F.coalesce("_session_wait", F.lit("")) != "OLEDB") & (F.col("wait_type") != "OLEDB")
    )
    resource = without_latch_note(F.col("resource_description"))
    joined = joined.withColumn("resource_description", resource)
    if databases is None:
        joined = joined.withColumn("database_name", F.lit(None).cast("string"))
    else:
        page_db = F.split("resource_description", ":")[0].try_cast("bigint")
        names = databases.select(*K, F.col("database_id").cast("bigint").alias("_db"), F.col("name").alias("database_name"))
        joined = joined.withColumn("_db", page_db).join(names, [*K, "_db"], "left")
    blocked_here = F.col("blocking_session_id").isNotNull() & (F.col("blocking_session_id") == F.col("_blocked"))
    return (
        joined.select(
            *K, "waiting_task_address",
            F.concat("wait_type", wait_detail(F.col("wait_type"), F.col("resource_description"), F.col("database_name"))).alias("wait_type"),
            F.when(blocked_here & is_lock_wait(F.col("wait_type")), F.col("resource_description")).alias("block_text"),
            "wait_duration_ms",
        )
        .groupBy(*K, "waiting_task_address", "wait_type")
        .agg(F.max("wait_duration_ms").alias("wait_duration_ms"), F.max("block_text").alias("block_text"))
    )


def wait_profile(tasks: DataFrame, waits: DataFrame) -> DataFrame:
    """Count, minimum, integer mean and maximum wait per request and wait type.

    ``tasks`` comes from ``active_tasks``, ``waits`` from ``session_waits``. A task
    with runnable time counts as runnable and not as waiting.
    """
    totals = tasks.groupBy(*SK).agg(
        F.sum("pending_io_count").alias("physical_io"), F.sum("context_switches_count").alias("context_switches"),
        F.sum("thread_cpu_time").alias("thread_cpu"), F.count(F.lit(1)).alias("tasks"),
    )
    waiting = waits.filter("wait_duration_ms > 0").withColumnRenamed("waiting_task_address", "_address")
    on_task = (
        (F.col("t.task_address") == F.col("w._address")) & F.col("t.runnable_time").isNull()
        & (F.col("t.server_id") == F.col("w.server_id")) & (F.col("t.collection_time") == F.col("w.collection_time"))
    )
    joined = tasks.alias("t").join(waiting.alias("w"), on_task, "left")
    amount = F.coalesce(F.col("t.runnable_time"), F.col("w.wait_duration_ms"))
    shaped = joined.select(
        *[F.col(f"t.{c}").alias(c) for c in SK],
        F.when(F.col("t.runnable_time").isNotNull(), F.lit(RUNNABLE)).otherwise(F.col("w.wait_type")).alias("wait_type"),
        amount.alias("amount"), F.col("w.block_text").alias("block_text"),
    )
    grouped = shaped.groupBy(*SK, "wait_type").agg(
        F.nullif(F.count("amount"), F.lit(0)).alias("num_waits"),
        F.min("amount").alias("min_wait_ms"),
        int_div(F.sum("amount"), F.count("amount")).alias("avg_wait_ms"),
        F.max("amount").alias("max_wait_ms"),
        F.max("block_text").alias("block_text"),
    )
    return null_safe_join(grouped, totals, SK, "left")


def rank_waits(profile: DataFrame) -> DataFrame:
    """Order the waits of a request: blocked ones first, then by count, then by type.

    Wait types carry page, database and latch names, so a request may have any number.
    """
    order = [F.col("block_text").desc_nulls_last(), F.col("num_waits").desc_nulls_last(), F.col("wait_type").asc_nulls_first()]
    return number_small_groups(profile, SK, order, "wait_rank")


WAITS_PER_PAGE = 1000


def _wait_texts(ranked: DataFrame, page_rows: int) -> DataFrame:
    text = wait_group_text(
        F.col("num_waits"), F.col("min_wait_ms"), F.col("avg_wait_ms"), F.col("max_wait_ms"), F.col("wait_type")
    )
    return ranked.withColumns({"_text": text, "page_no": F.floor((F.col("wait_rank") - 1) / page_rows).cast("int")})


def _in_order(text: Column) -> Column:
    """The texts of a page as one, by rank; those without a text are left out."""
    pairs = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("wait_rank", text.alias("_text")))))
    return F.array_join(F.transform(pairs, lambda w: w["_text"]), ", ")


def task_summary(ranked: DataFrame, page_rows: int = WAITS_PER_PAGE) -> DataFrame:
    """One row per request: totals, the first block text and all its waits as one text.

    Waits are put in order within pages of ``page_rows`` and the pages joined, so none is cut
    however many there are; ``wait_pages`` counts the pages, which the operator of that name
    writes apart.
    """
    listed = _wait_texts(ranked, page_rows)
    pages = listed.groupBy(*SK, "page_no").agg(
        *[F.max(c).alias(c) for c in _TOTALS],
        F.max(F.when(F.col("wait_rank") == 1, F.col("block_text"))).alias("block_text"),
        F.when(F.count("_text") > 0, _in_order(F.col("_text"))).alias("_page"),
    )
    has_text = F.col("_page").isNotNull()
    texts = F.array_sort(F.collect_list(F.when(has_text, F.struct("page_no", "_page"))))
    return pages.groupBy(*SK).agg(
        *[F.max(c).alias(c) for c in [*_TOTALS, "block_text"]],
        F.array_join(F.transform(texts, lambda p: p["_page"]), ", ").alias("wait_info"),
        (F.max(F.when(has_text, F.col("page_no"))) + 1).alias("wait_pages"),
    )


def wait_pages(ranked: DataFrame, page_rows: int = WAITS_PER_PAGE) -> DataFrame:
    """All waits of each request as texts of at most ``page_rows`` waits each: SK, page_no, wait_info.

    Waits are numbered before they are put together, so no request is gathered whole and no
    wait is cut, however many there are.
    """
    listed = _wait_texts(ranked, page_rows).filter("_text is not null")
    return listed.groupBy(*SK, "page_no").agg(_in_order(F.col("_text")).alias("wait_info"))


def blocked_object_names(blocked: DataFrame, databases: DataFrame, partitions: DataFrame, objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Names of the object and schema each blocked request waits for.

    ``blocked`` has SK and ``block_text``. Names are looked up per server and database. The
    catalog is far larger than what is waited for, so its objects are cut to these first.
    """
    info = blocked.withColumn("_info", block_info(F.col("block_text")))
    info = info.select(
        *SK, "block_text", F.col("_info.lock_type").alias("lock_type"), F.col("_info.database_id").alias("database_id"),
        F.col("_info.object_id").alias("_object"), F.col("_info.hobt_id").alias("hobt_id"),
        metadata_schema_id(F.col("_info")).alias("_schema"),
    )
    part = partitions.select("server_id", "database_name", "hobt_id", F.col("object_id").alias("_part_object"))
    obj = objects.select(
        "server_id", "database_name", F.col("object_id").alias("target_object_id"),
        F.col("name").alias("object_name"), F.col("schema_id").alias("_object_schema"),
    )
    sch = schemas.select("server_id", "database_name", F.col("schema_id").alias("target_schema_id"), F.col("name").alias("schema_name"))
    at = ["server_id", "database_name", "target_object_id"]
    placed = freeze(
        info.join(databases.select("server_id", "database_id", F.col("name").alias("database_name")), ["server_id", "database_id"], "left")
        .join(part, ["server_id", "database_name", "hobt_id"], "left")
        .withColumn("target_object_id", F.coalesce("_part_object", "_object"))
    )
    wanted = cut_lineage(placed.select(*at).distinct())
    return (
        placed.join(obj.join(wanted, at, "left_semi"), at, "left")
        .withColumn("target_schema_id", F.coalesce("_object_schema", "_schema"))
        .join(sch, ["server_id", "database_name", "target_schema_id"], "left")
        .select(*SK, "lock_type", "database_name", "hobt_id", "target_object_id", "schema_name", "object_name")
    )
