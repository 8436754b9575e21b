"""Queries on collectors, jobs, replicas, space, retention, alerts and reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from fleetscope.keys import K
from fleetscope.operators import alerts, filters, jobs, ranking, replicas, retention, space
from fleetscope.plans import collectors, notices
from fleetscope.runtime import freeze, scratch_path
from fleetscope.schemas import HISTORY
from fleetscope.sinks import ddl, history, outbox, report
from fleetscope.sources import telemetry
from fleetscope.sources.cpu_records import parse_cpu_records
from harness import labels
from harness.core import query

NOW = datetime(2024, 1, 31)

# ---- CPU records ---------------------------------------------------------------------

_CPU_SQL = """
parsed AS (
  SELECT r.server_id, r.collection_time, r.collection_time - (c.ms_ticks - r.ts_ticks) * INTERVAL '1' MILLISECOND AS event_time,
         CAST(regexp_extract(record, 'Record id="([0-9]+)"', 1) AS BIGINT) AS record_id,
         CAST(regexp_extract(record, '<SystemIdle>([0-9]+)', 1) AS BIGINT) AS system_idle,
         CAST(regexp_extract(record, '<ProcessUtilization>([0-9]+)', 1) AS BIGINT) AS sql_process
  FROM fx_cpu r JOIN fx_clock c USING (server_id, collection_time) WHERE record LIKE '%<SystemHealth>%'),
cpu AS (SELECT *, 100 - system_idle - sql_process AS other_process FROM parsed),
fresh AS (SELECT * FROM cpu WHERE event_time > collection_time - INTERVAL '15' MINUTE),
unseen AS (SELECT * FROM fresh WHERE NOT EXISTS (SELECT 1 FROM fx_cpu_history h WHERE h.server_id = fresh.server_id AND h.record_id = fresh.record_id)),
newest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY record_id DESC) AS r FROM unseen) WHERE r <= 15)
"""


@query("parse_cpu_records", "WITH " + _CPU_SQL + "SELECT * FROM cpu")
def _(v):
    return parse_cpu_records(v("fx_cpu"), v("fx_clock"))


@query("latest_unseen", "WITH " + _CPU_SQL + "SELECT * FROM fresh")
def _(v):
    return filters.latest_only(parse_cpu_records(v("fx_cpu"), v("fx_clock"), 15), "collection_time")


@query("anti_join_new_records", "WITH " + _CPU_SQL + """
SELECT c.server_id, c.record_id, c.system_idle FROM cpu c WHERE NOT EXISTS (SELECT 1 FROM fx_cpu_history h WHERE h.server_id = c.server_id AND h.record_id = c.record_id)
""")
def _(v):
    parsed = parse_cpu_records(v("fx_cpu"), v("fx_clock"))
    return filters.anti_join_new_records(parsed, v("fx_cpu_history")).select("server_id", "record_id", "system_idle")


@query("top_recent_records", "WITH " + _CPU_SQL + """
SELECT server_id, record_id, sql_process FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY record_id DESC) AS r FROM cpu) WHERE r <= 15
""")
def _(v):
    return filters.top_recent_records(parse_cpu_records(v("fx_cpu"), v("fx_clock"))).select("server_id", "record_id", "sql_process")


@query("cpu_history", "WITH " + _CPU_SQL + "SELECT * FROM newest")
def _(v):
    return collectors.cpu_history(v("fx_cpu"), v("fx_clock"), v("fx_cpu_history"))


@query("cpu_history_after_poll", "WITH " + _CPU_SQL + """
SELECT * FROM (SELECT server_id, record_id, event_time, sql_process, system_idle, other_process FROM newest UNION ALL SELECT * FROM fx_cpu_history)
WHERE CAST(event_time AS DATE) >= DATE '2024-02-20' - INTERVAL '31' DAY
""")
def _(v):
    new = collectors.cpu_history(v("fx_cpu"), v("fx_clock"), v("fx_cpu_history"))
    return collectors.cpu_history_after_poll(new, v("fx_cpu_history"), datetime(2024, 2, 20))


# ---- retention and history tables ----------------------------------------------------


@query("purge_history", """
SELECT server_id, record_id, event_time FROM fx_cpu_history WHERE CAST(event_time AS DATE) >= DATE '2024-01-17'
""")
def _(v):
    kept = retention.purge_history(v("fx_cpu_history"), "event_time", 31, "date", datetime(2024, 2, 17, 12))
    return kept.select("server_id", "record_id", "event_time")


@query("purge_history_timestamp", """
SELECT server_id, database_name, start_time FROM fx_commands WHERE start_time >= TIMESTAMP '2000-01-01 12:00:00'
""")
def _(v):
    kept = retention.purge_history(v("fx_commands"), "start_time", 30, "timestamp", datetime(2000, 1, 31, 12))
    return kept.select("server_id", "database_name", "start_time")


@query("append_history", "SELECT server_id, record_id, event_time, sql_process, system_idle, other_process FROM fx_cpu_history")
def _(v):
    path = scratch_path(v.spark, "cpu-usage")
    schema = HISTORY["cpu_usage"]
    history.append_history(v("fx_cpu_history").filter("server_id < 4"), path, schema, "event_time")
    history.append_history(v("fx_cpu_history").filter("server_id >= 4"), path, schema, "event_time")
    return history.read_history(v.spark, path, schema)


def _made_table(v) -> tuple[str, str]:
    """A new catalog table of notifications from its schema text, with its folder."""
    path = scratch_path(v.spark, "by-name")
    table = f"by_name_{path[-32:]}"
    shape = v.spark.createDataFrame([], HISTORY["cpu_usage"])
    v.spark.sql(f"{ddl.schema_ddl(shape, table)}\nLOCATION '{path}'")
    return table, path


@query("append_by_name", "SELECT server_id, record_id, event_time, sql_process, system_idle, other_process FROM fx_cpu_history")
def _(v):
    table, path = _made_table(v)
    rows = v("fx_cpu_history")
    for part, columns in (("server_id < 4", sorted(rows.columns)), ("server_id >= 4", sorted(rows.columns, reverse=True))):
        history.append_by_name(rows.filter(part).select(*columns, F.lit(0).alias("not_stored")), table)
    v.spark.sql(f"DROP TABLE {table}")
    return v.spark.read.schema(HISTORY["cpu_usage"]).parquet(path)


@query("schema_ddl", """
SELECT 'server_id' AS col_name, 'bigint' AS data_type, count(*) AS stored FROM fx_cpu_history
UNION ALL SELECT 'record_id', 'bigint', count(*) FROM fx_cpu_history
UNION ALL SELECT 'event_time', 'timestamp', count(*) FROM fx_cpu_history
UNION ALL SELECT 'sql_process', 'bigint', count(*) FROM fx_cpu_history
UNION ALL SELECT 'system_idle', 'bigint', count(*) FROM fx_cpu_history
UNION ALL SELECT 'other_process', 'bigint', count(*) FROM fx_cpu_history
""")
def _(v):
    table, path = _made_table(v)
    history.append_by_name(v("fx_cpu_history"), table)
    columns = v.spark.sql(f"DESCRIBE TABLE {table}").select("col_name", "data_type")
    stored = v.spark.read.parquet(path).agg(*[F.count(F.lit(1)).alias(f.name) for f in HISTORY["cpu_usage"].fields])
    counts = stored.unpivot([], [f.name for f in HISTORY["cpu_usage"].fields], "col_name", "stored")
    return columns.join(counts, "col_name")


@query("replace_today", """
SELECT server_id, record_id, event_time, CAST(CASE WHEN CAST(event_time AS DATE) = DATE '2024-01-15' THEN 0 ELSE sql_process END AS BIGINT) AS sql_process,
       system_idle, other_process FROM fx_cpu_history
""")
def _(v):
    path = scratch_path(v.spark, "cpu-day")
    schema, rows = HISTORY["cpu_usage"], v("fx_cpu_history")
    history.append_history(rows, path, schema, "event_time")
    day = rows.withColumn("sql_process", F.lit(0).cast("bigint"))
    for _attempt in range(2):
        history.replace_day(day.select(*[f.name for f in schema.fields]), path, "event_time", date(2024, 1, 15), "collection_date")
    return history.read_history(v.spark, path, schema)


@query("purge_days", """
SELECT server_id, record_id, event_time, sql_process, system_idle, other_process FROM fx_cpu_history WHERE CAST(event_time AS DATE) >= DATE '2024-01-10'
""")
def _(v):
    path = scratch_path(v.spark, "cpu-purge")
    schema = HISTORY["cpu_usage"]
    history.append_history(v("fx_cpu_history"), path, schema, "event_time")
    history.purge_days(v.spark, path, datetime(2024, 2, 10), 31)
    return history.read_history(v.spark, path, schema)


@query("union_databases", """
SELECT 'db' || CAST(l_suppkey % 25 AS STRING) AS database_name, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT) * 1280 + l_partkey % 128) AS BIGINT) AS pages
FROM lineitem GROUP BY ALL
""")
def _(v):
    # Results as they come from single databases: without their name, one relation each.
    files = v("fx_files")
    parts = {f"db{k}": files.filter(F.col("database_name") == f"db{k}").drop("database_name") for k in range(25)}
    return telemetry.union_databases(parts).groupBy("database_name").agg(F.count(F.lit(1)).alias("files"), F.sum("size_pages").alias("pages"))


# ---- scheduled jobs ------------------------------------------------------------------

_HMS = "substr({0}, 1, 2) || ':' || substr({0}, 3, 2) || ':' || substr({0}, 5, 2)"
_START = _HMS.format("lpad(CAST(active_start_time AS STRING), 6, '0')")
_END = _HMS.format("lpad(CAST(active_end_time AS STRING), 6, '0')")
_DAYS = " || ".join(
    f"CASE WHEN (freq_interval // {1 << i}) % 2 = 1 THEN '{'' if i == 0 else ', '}{day}' ELSE '' END" for i, day in enumerate(labels.WEEKDAY.values())
)
_EVERY = " ".join(
    f"WHEN {code} THEN 'Occurs every ' || CAST(freq_subday_interval AS STRING) || ' {unit}(s) between ' || {_START} || ' & ' || {_END}"
    for code, unit in labels.SUBDAY_UNIT.items()
)


def _action(code: str, step: str, name: str) -> str:
    jump = f"CASE {code} WHEN 4 THEN 'Go to Step: [' || CAST({step} AS STRING) || '] ' || {name} END"
    return labels.case(code, labels.STEP_ACTION, jump)


_JOB_SQL = f"""
decoded AS (
  SELECT server_id, job_id, job_name, job_owner, job_category, job_description, is_enabled, job_created_on, job_last_modified_on,
         originating_server_name, job_start_step_no, job_start_step_name, is_scheduled, job_schedule_name, job_deletion_criterion,
         schedule_type, occurrence,
         CASE freq_type WHEN 4 THEN 'Occurs every ' || CAST(freq_interval AS STRING) || ' day(s)'
              WHEN 8 THEN 'Occurs every ' || CAST(freq_recurrence_factor AS STRING) || ' week(s) on ' || {_DAYS}
              WHEN 16 THEN 'Occurs on Day ' || CAST(freq_interval AS STRING) || ' of every ' || CAST(freq_recurrence_factor AS STRING) || ' month(s)'
              WHEN 32 THEN 'Occurs on ' || {labels.case('freq_relative_interval', labels.RELATIVE_WEEK)}
                   || ' ' || {labels.case('freq_interval', labels.RELATIVE_DAY)} || ' of every ' || CAST(freq_recurrence_factor AS STRING) || ' month(s)' END AS recurrence,
         CASE freq_subday_type WHEN 1 THEN 'Occurs once at ' || {_START} {_EVERY} END AS frequency,
         substr(CAST(active_start_date AS STRING), 1, 4) || '-' || substr(CAST(active_start_date AS STRING), 5, 2) || '-' || substr(CAST(active_start_date AS STRING), 7, 2) AS schedule_usage_start_date,
         CASE WHEN active_end_date IS NOT NULL THEN '9999-12-31' END AS schedule_usage_end_date, schedule_created_on, schedule_last_modified_on,
         step_no, step_name, {labels.case('subsystem', labels.STEP_TYPE, 'subsystem')} AS step_type,
         run_as, database_name, executable_command,
         {_action('success_code', 'on_success_step_id', 'success_name')} AS on_success_action, retry_attempts, retry_interval,
         {_action('fail_code', 'on_fail_step_id', 'fail_name')} AS on_failure_action
  FROM fx_job_view)
"""


def _definitions(v):
    dims = v("fx_job_dims")
    regions = dims.select("server_id", "n_regionkey").distinct()
    named = lambda key, prefix: regions.select(
        "server_id", F.col("n_regionkey").alias(key), F.concat(F.lit(prefix), F.col("n_regionkey").cast("string")).alias("name")
    )
    nations = lambda key: dims.select("server_id", F.col("n_nationkey").alias(key), F.col("n_name").alias("name"))
    return jobs.job_definition_view(
        v("fx_jobs"), v("fx_steps"), v("fx_schedules"), v("fx_job_schedules"), named("category_id", "category"),
        nations("proxy_id"), nations("owner_sid"), named("originating_server_id", "server"),
    )


@query("job_definition_view", "WITH " + _JOB_SQL + "SELECT * FROM decoded")
def _(v):
    return _definitions(v)


_STORED = [f.name for f in HISTORY["job_definitions"].fields if f.name != "audit_date"]


@query("job_definitions_store", "WITH " + _JOB_SQL + f"""
SELECT {', '.join(_STORED)} FROM decoded d WHERE EXISTS (SELECT 1 FROM fx_replica_states s WHERE s.server_id = d.server_id AND s.is_local AND s.role = 'PRIMARY')
""")
def _(v):
    path = scratch_path(v.spark, "job-definitions")
    definitions, roles = freeze(_definitions(v)), replicas.replica_role(v("fx_replica_states"), v("fx_groups"))
    # An earlier run of the same day, and one that has left the retention.
    for rows, now in ((definitions, datetime(2023, 12, 1)), (definitions.withColumn("is_enabled", F.lit("Old")), NOW), (definitions, NOW)):
        collectors.store_job_definitions(v.spark, rows, roles, path, now)
    narrow = ("job_start_step_no", "step_no", "retry_attempts", "retry_interval")
    stored = history.read_history(v.spark, path, HISTORY["job_definitions"])
    return stored.select(*[F.col(c).cast("int").alias(c) if c in narrow else F.col(c) for c in _STORED])


def _changed(definitions):
    """The same definitions as another server might hold them."""
    return definitions.filter("job_schedule_name is null or job_schedule_name <> 'Schedule NATION_3'").withColumns({
        "job_description": F.when(F.col("job_category") == "category1", "Changed by hand").otherwise(F.upper("job_description")),
        "job_name": F.upper("job_name"),
    })


_COMPARED = ", ".join(f"lower({n}) AS {n}" if text else n for n, text in jobs.COMPARED.items())
_DRIFT_SQL = _JOB_SQL + f""",
changed AS (
  SELECT * REPLACE (CASE WHEN job_category = 'category1' THEN 'Changed by hand' ELSE upper(job_description) END AS job_description, upper(job_name) AS job_name)
  FROM decoded WHERE job_schedule_name IS NULL OR job_schedule_name <> 'Schedule NATION_3'),
a AS (SELECT server_id, {_COMPARED}, CASE WHEN executable_command IS NOT NULL THEN 1 ELSE 0 END AS has_command FROM decoded),
b AS (SELECT server_id, {_COMPARED}, CASE WHEN executable_command IS NOT NULL THEN 1 ELSE 0 END AS has_command FROM changed),
drift AS (SELECT 'primary' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'secondary' AS side, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
"""


@query("definition_drift", "WITH " + _DRIFT_SQL + "SELECT * FROM drift")
def _(v):
    definitions = freeze(_definitions(v))
    return jobs.definition_drift(definitions, _changed(definitions), ["server_id"])


def _fleet_drift(v):
    """Server n is primary of group n; server n + 100 holds its changed copy."""
    definitions = freeze(_definitions(v))
    second = F.col("server_id") + 100
    group = F.concat(F.lit("ag"), F.col("server_id").cast("string")).alias("group_name")
    servers = v("fx_jobs").select("server_id").distinct()
    roles = servers.select("server_id", group, F.lit("PRIMARY").alias("role")).unionByName(
        servers.select(second.alias("server_id"), group, F.lit("SECONDARY").alias("role"))
    )
    everywhere = definitions.unionByName(_changed(definitions).withColumn("server_id", second))
    return collectors.job_definition_drift(everywhere, roles)


@query("job_definition_drift", "WITH " + _DRIFT_SQL + """
SELECT 'ag' || CAST(server_id AS STRING) AS group_name, server_id + 100 AS secondary_id, * EXCLUDE (server_id) FROM drift
""")
def _(v):
    return _fleet_drift(v)


@query("drift_notices", "WITH " + _DRIFT_SQL + """
SELECT server_id + 100 AS server_id, 'Agent job definitions differ between Primary and Secondary. Current secondary: ' || CAST(server_id + 100 AS STRING) AS mail_subject,
       'Differing definitions: ' || CAST(count(*) AS STRING) AS mail_body FROM drift GROUP BY server_id
""")
def _(v):
    return notices.drift_notices(_fleet_drift(v))


# ---- replicas ------------------------------------------------------------------------

_ROLE_SQL = """
roles AS (SELECT DISTINCT s.server_id, g.name AS group_name, s.role FROM fx_replica_states s JOIN fx_groups g USING (server_id, group_id) WHERE s.is_local)
"""


def _roles(v):
    return replicas.replica_role(v("fx_replica_states"), v("fx_groups"))


@query("replica_role", "WITH " + _ROLE_SQL + "SELECT * FROM roles")
def _(v):
    return _roles(v)


@query("replica_gate", "WITH " + _ROLE_SQL + "SELECT d.server_id, d.database_id FROM fx_databases d JOIN roles r USING (server_id) WHERE r.role = 'PRIMARY'")
def _(v):
    return replicas.replica_gate(v("fx_databases"), _roles(v)).select("server_id", "database_id")


@query("unhealthy_replicas", """
SELECT server_id, database_id, synchronization_health FROM fx_replica_states WHERE is_local AND synchronization_health <> 'HEALTHY'
""")
def _(v):
    return filters.unhealthy_replicas(v("fx_replica_states")).select("server_id", "database_id", "synchronization_health")


_UNSYNCED_SQL = """
unsynced AS (
  SELECT d.server_id, d.database_id, d.name, s.synchronization_state, s.synchronization_health
  FROM fx_databases d LEFT JOIN fx_replica_states s USING (server_id, collection_time, database_id)
  WHERE d.database_id > 4 AND NOT EXISTS (SELECT 1 FROM fx_ignored i WHERE i.server_id = d.server_id AND i.database_name = d.name)
    AND ((d.state <> 'OFFLINE' AND s.database_id IS NULL) OR s.synchronization_state <> 'SYNCHRONIZED' OR s.synchronization_health <> 'HEALTHY'))
"""


@query("unsynced_databases", "WITH " + _UNSYNCED_SQL + "SELECT * FROM unsynced")
def _(v):
    found = replicas.unsynced_databases(v("fx_databases"), v("fx_replica_states"), v("fx_ignored"))
    return found.select("server_id", "database_id", "name", "synchronization_state", "synchronization_health")


@query("exists_flags", """
SELECT d.server_id, d.database_id, EXISTS (SELECT 1 FROM fx_replica_states s WHERE s.server_id = d.server_id AND s.database_id = d.database_id) AS in_group,
       EXISTS (SELECT 1 FROM fx_ignored i WHERE i.server_id = d.server_id AND i.database_name = d.name) AS is_ignored
FROM fx_databases d
""")
def _(v):
    databases = v("fx_databases").drop("in_group")
    flagged = ranking.exists_flag(databases, v("fx_replica_states"), ["server_id", "database_id"], "in_group")
    ignored = v("fx_ignored").withColumnRenamed("database_name", "name")
    return ranking.exists_flag(flagged, ignored, ["server_id", "name"], "is_ignored").select("server_id", "database_id", "in_group", "is_ignored")


@query("job_enabled_log", "WITH " + _ROLE_SQL + """
SELECT j.server_id, TIMESTAMP '2024-01-31 00:00:00' AS audit_date, r.role AS replica_role, j.job_id, j.name AS job_name, CASE j.enabled WHEN 1 THEN 'Yes' ELSE 'No' END AS is_enabled
FROM fx_jobs j LEFT JOIN roles r USING (server_id)
""")
def _(v):
    return collectors.job_enabled_log(v("fx_jobs"), v("fx_replica_states"), v("fx_groups"), NOW)


# ---- space ---------------------------------------------------------------------------


@query("space_tracking", """
SELECT server_id, collection_time AS poll_date, database_name, logical_name, CASE file_type WHEN 'ROWS' THEN 'DATA' ELSE file_type END AS file_type,
       filegroup_name, physical_name AS physical_file_location, ((size_pages * 200 + 128) // 256) / 100 AS space_mb, used_pages // 128 AS used_space_mb,
       ((((size_pages * 200 + 128) // 256) * 128 - used_pages * 100) * 2 + 128) // 256 / 100 AS free_space_mb
FROM fx_files
""")
def _(v):
    rows = collectors.space_tracking(v("fx_files"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("space_mb", "free_space_mb")})


@query("space_history", """
SELECT server_id, collection_time AS poll_date, database_name, logical_name, physical_name AS physical_file_location, used_pages // 128 AS used_space_mb,
       ((size_pages * 200 + 128) // 256) / 100 AS space_mb
FROM fx_files
""")
def _(v):
    path = scratch_path(v.spark, "space")
    rows = collectors.space_tracking(v("fx_files"))
    # A poll of a year and a day ago leaves with this one.
    old = rows.withColumn("poll_date", F.col("poll_date") - F.expr("interval 366 days"))
    history.append_history(old, path, HISTORY["space"], "poll_date")
    collectors.store(v.spark, rows, path, "space", "poll_date", NOW)
    stored = history.read_history(v.spark, path, HISTORY["space"]).withColumn("space_mb", F.col("space_mb").cast("double"))
    return stored.select("server_id", "poll_date", "database_name", "logical_name", "physical_file_location", "used_space_mb", "space_mb")


_TEMP_SQL = """
temp AS (
  SELECT server_id, 'TempDB' AS database_name, logical_name AS logical_file_name, physical_name AS physical_file_name, database_status AS status, updateability, recovery_mode,
         size_pages // 128 AS file_size_mb, used_pages // 128 AS space_used_mb, (size_pages - used_pages) // 128 AS free_space_mb,
         ((size_pages - used_pages) * 2000 + size_pages) // (2 * size_pages) AS thousandths,
         CASE WHEN max_size_pages = -1 THEN 'Unlimited' ELSE CAST(max_size_pages // 128 AS STRING) || ' MB' END AS max_size,
         CASE WHEN file_flags >= 1048576 THEN CAST(growth AS STRING) || '%' ELSE CAST(growth // 128 AS STRING) || ' MB' END AS growth, collection_time AS poll_date
  FROM fx_files)
"""


@query("tempdb_tracking", "WITH " + _TEMP_SQL + """
SELECT * EXCLUDE (thousandths), CAST(thousandths // 10 AS STRING) || '.' || CAST(thousandths % 10 AS STRING) || '00%' AS free_space_pct FROM temp
""")
def _(v):
    return collectors.tempdb_tracking(v("fx_files"))[0]


@query("min_free_space", "WITH " + _TEMP_SQL + """
SELECT server_id, poll_date, min(thousandths // 10) AS min_free_percent, min(thousandths // 10) < 40 AS needs_drilldown FROM temp GROUP BY ALL
""")
def _(v):
    return collectors.tempdb_tracking(v("fx_files"))[1]


@query("tempdb_requests", """
WITH low AS (SELECT server_id, collection_time FROM fx_files GROUP BY ALL HAVING min(((size_pages - used_pages) * 2000 + size_pages) // (20 * size_pages)) < 40),
pages AS (
  SELECT server_id, collection_time, session_id, request_id, user_objects_alloc_page_count + internal_objects_alloc_page_count AS a,
         user_objects_dealloc_page_count + internal_objects_dealloc_page_count AS d FROM fx_task_space
  UNION ALL
  SELECT server_id, collection_time, session_id, -1, user_objects_alloc_page_count + internal_objects_alloc_page_count,
         user_objects_dealloc_page_count + internal_objects_dealloc_page_count FROM fx_session_space)
SELECT p.server_id, p.collection_time AS poll_date, p.session_id, CAST(p.request_id AS BIGINT) AS request_id, CAST(sum(a) AS BIGINT) AS tempdb_allocations,
       CAST(greatest(sum(a) - sum(d), 0) AS BIGINT) AS tempdb_current
FROM pages p JOIN low USING (server_id, collection_time) JOIN fx_lock_sessions s USING (server_id, collection_time, session_id) GROUP BY p.server_id, p.collection_time, p.session_id, p.request_id
""")
def _(v):
    polls = collectors.tempdb_tracking(v("fx_files"))[1]
    return collectors.tempdb_requests(polls, v("fx_task_space"), v("fx_session_space"), v("fx_lock_sessions"))


@query("database_sizes", "SELECT server_id, database_name, CAST(sum(size_pages) AS BIGINT) AS database_pages FROM fx_files WHERE file_type = 'ROWS' GROUP BY ALL")
def _(v):
    return space.database_sizes(v("fx_files"))


@query("extent_usage", """
SELECT server_id, collection_time, database_name, CAST(sum(size_pages) AS BIGINT) AS allocated_pages, CAST(sum(used_pages) AS BIGINT) AS modified_pages FROM fx_files GROUP BY ALL
""")
def _(v):
    pages = v("fx_files").withColumnsRenamed({"size_pages": "allocated_extent_pages", "used_pages": "modified_extent_pages"})
    return space.extent_usage(pages)


# ---- reports and notices -------------------------------------------------------------

_CELL = "'<td align=\"left\" style=\"' || CASE WHEN {0} IS NULL THEN 'color:#FF00FF;' ELSE 'color:black' END || '\">' || coalesce({0}, 'NULL') || '</td>'"


def _document_sql(rows: str, order: str, cells: list[str], titles: list[str], heading: str, page: int) -> str:
    markup = " || ".join(_CELL.format(c) for c in cells)
    head = "".join(f"<th>{t}</th>" for t in titles)
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY {order}) AS n FROM {rows}),
document AS (
  SELECT server_id, (n - 1) // {page} AS page_no,
         '<html><body>' || {heading} || '<table border="1"><tr bgcolor="#EEEDED">{head}</tr>'
         || string_agg('<tr bgcolor="' || CASE WHEN n % 2 = 1 THEN '#FFFFFF' ELSE '#EEEDED' END || '">' || {markup} || '</tr>', '' ORDER BY n) || '</table></body></html>' AS body
  FROM numbered GROUP BY server_id, (n - 1) // {page})
"""


@query("report_document", "WITH " + _document_sql(
    "fx_replica_states", "database_id", ["CAST(database_id AS STRING)", "synchronization_state", "CASE WHEN is_local THEN database_state END"],
    ["Id", "State", "Database"], "''", 50) + "SELECT * FROM document")
def _(v):
    rows = v("fx_replica_states").withColumn("shown", F.when(F.col("is_local"), F.col("database_state")))
    return report.report_document(
        rows, ["server_id"], {"database_id": "Id", "synchronization_state": "State", "shown": "Database"}, [F.col("database_id")], page_rows=50
    )


@query("row_parity", """
SELECT server_id, row_number() OVER (PARTITION BY server_id ORDER BY database_id) AS row_number, row_number() OVER (PARTITION BY server_id ORDER BY database_id) % 2 AS row_parity
FROM fx_replica_states
""")
def _(v):
    # A small limit sends every server through the sliced numbering.
    rows = report.report_rows(v("fx_replica_states"), ["server_id"], {"database_id": "Id"}, [F.col("database_id")])
    return rows.select("server_id", *[F.col(c).cast("bigint").alias(c) for c in ("row_number", "row_parity")])


@query("sync_check", "WITH " + _UNSYNCED_SQL + ", shown AS (SELECT DISTINCT server_id, name FROM unsynced), " + _document_sql(
    "shown", "name", ["name"], ["DatabaseName"], "'<h3>Unsynchronised Databases - ' || CAST(server_id AS STRING) || '</h3>'", 500) + """
SELECT server_id, page_no, 'Unsynchronised Databases - ' || CAST(server_id AS STRING) AS mail_subject, body AS mail_body FROM document
""")
def _(v):
    return notices.sync_check(v("fx_databases"), v("fx_replica_states"), v("fx_ignored"))


@query("replica_health_report", "WITH " + _ROLE_SQL + """, bad AS (
  SELECT s.*, d.name FROM fx_replica_states s LEFT JOIN fx_databases d USING (server_id, collection_time, database_id) WHERE s.is_local AND s.synchronization_health <> 'HEALTHY'), """
    + _document_sql("bad", "database_id", ["name", "synchronization_state", "synchronization_health", "database_state"],
                    ["Database Name", "Synchronization State", "Synchronization Health", "Database State"], "''", 500) + """
SELECT d.server_id, d.page_no, 'Availability Group Health Alert For ' || CAST(d.server_id AS STRING) AS mail_subject,
       'Server ' || CAST(d.server_id AS STRING) || ' is the ' || coalesce(r.role, 'N/A') || ' member of ' || coalesce(r.group_name, 'N/A') || ': ' || d.body AS mail_body
FROM document d LEFT JOIN roles r USING (server_id)
""")
def _(v):
    return notices.replica_health_report(v("fx_replica_states"), v("fx_databases"), _roles(v))


# ---- alerts and outbox ---------------------------------------------------------------


def _alert_sql(view: str) -> str:
    return f"""
WITH RECURSIVE matched AS (
  SELECT *, 'Severity ' || lpad(CAST(severity AS STRING), 3, '0') AS rule FROM {view} WHERE severity BETWEEN 16 AND 25
  UNION ALL SELECT *, 'Error Number ' || CAST(error_number AS STRING) FROM {view} WHERE error_number IN (823, 824, 825)),
times AS (SELECT server_id, rule, event_time, min(event_id) AS event_id, row_number() OVER (PARTITION BY server_id, rule ORDER BY event_time) AS n FROM matched GROUP BY server_id, rule, event_time),
walk AS (
  SELECT server_id, rule, n, event_time AS last_fired, TRUE AS fires FROM times WHERE n = 1
  UNION ALL
  SELECT t.server_id, t.rule, t.n, CASE WHEN t.event_time >= w.last_fired + INTERVAL '60' SECOND THEN t.event_time ELSE w.last_fired END, t.event_time >= w.last_fired + INTERVAL '60' SECOND
  FROM walk w JOIN times t ON t.server_id = w.server_id AND t.rule = w.rule AND t.n = w.n + 1),
fired AS (SELECT t.server_id, t.rule, t.event_id, t.event_time FROM walk w JOIN times t USING (server_id, rule, n) WHERE w.fires)
"""


@query("alert_events", _alert_sql("fx_errors") + "SELECT * FROM fired")
def _(v):
    return alerts.cooldown_alerts(v("fx_errors")).select("server_id", "rule", "event_id", "event_time")


@query("alert_events_storm", _alert_sql("fx_storm") + "SELECT * FROM fired")
def _(v):
    return alerts.cooldown_alerts(v("fx_storm")).select("server_id", "rule", "event_id", "event_time")


@query("rule_hits", """
SELECT r.rule, count(e.event_id) AS events FROM (
  SELECT 'Severity ' || lpad(CAST(s AS STRING), 3, '0') AS rule, s AS severity, NULL AS error_number FROM range(16, 26) t(s)
  UNION ALL SELECT 'Error Number ' || CAST(n AS STRING), NULL, n FROM range(823, 826) t(n)) r
LEFT JOIN fx_errors e ON e.severity = r.severity OR e.error_number = r.error_number GROUP BY r.rule
""")
def _(v):
    # Rules without events stay, so the rule list leads the join.
    hits = alerts.match_rules(v("fx_errors")).groupBy("rule").agg(F.count(F.lit(1)).alias("events"))
    return alerts.alert_rules(v.spark).select("rule").join(hits, "rule", "left").fillna(0, ["events"])


@query("number_series", """
SELECT n.number, count(o.o_custkey) AS orders FROM (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS number) n
LEFT JOIN orders o ON o.o_custkey = n.number GROUP BY n.number
""")
def _(v):
    numbers = telemetry.number_series(v.spark, v("customer").count())
    orders = v("orders").groupBy(F.col("o_custkey").alias("number")).agg(F.count(F.lit(1)).alias("orders"))
    return numbers.join(orders, "number", "left").fillna(0, ["orders"])


@query("alert_notices", _alert_sql("fx_errors") + """
SELECT f.server_id, f.rule || ' on server ' || CAST(f.server_id AS STRING) AS mail_subject, strftime(f.event_time, '%Y-%m-%d %H:%M:%S.%f') || ' ' || e.message AS mail_body
FROM fired f JOIN fx_errors e USING (event_id)
""")
def _(v):
    return notices.alert_notices(v("fx_errors"), NOW).select("server_id", "mail_subject", "mail_body")


def _outbox(v):
    notice = v("fx_errors").select(
        "server_id", F.concat(F.lit("Error "), F.col("error_number").cast("string")).alias("mail_subject"),
        F.concat(F.col("message"), F.lit(" #"), F.col("event_id").cast("string")).alias("mail_body"),
    )
    queued = outbox.outbox_enqueue(notice, NOW)
    # Errors 823 went out, 824 failed once and then went out, 825 failed.
    attempt = lambda error, state, minute: queued.filter(F.col("mail_subject") == f"Error {error}").select(
        "notification_id", F.lit(state).alias("mail_state"), F.lit(datetime(2024, 1, 31, 1, minute)).alias("attempted_at")
    )
    tries = attempt(823, 0, 1).unionByName(attempt(824, 1, 2)).unionByName(attempt(824, 0, 3)).unionByName(attempt(825, 1, 4))
    return queued, tries


@query("outbox_pending", """
SELECT server_id, 'Error ' || CAST(error_number AS STRING) AS mail_subject, message || ' #' || CAST(event_id AS STRING) AS mail_body FROM fx_errors WHERE error_number IN (825, 826)
""")
def _(v):
    return outbox.outbox_pending(*_outbox(v)).select("server_id", "mail_subject", "mail_body")


@query("outbox_state", """
SELECT server_id, message || ' #' || CAST(event_id AS STRING) AS mail_body, error_number IN (823, 824) AS delivered,
       CASE error_number WHEN 823 THEN TIMESTAMP '2024-01-31 01:01:00' WHEN 824 THEN TIMESTAMP '2024-01-31 01:03:00' END AS mail_delivered
FROM fx_errors
""")
def _(v):
    return outbox.outbox_state(*_outbox(v)).select("server_id", "mail_body", "delivered", "mail_delivered")


@query("text_aggregate", """
SELECT server_id, database_name, string_agg(DISTINCT file_type, ', ' ORDER BY file_type) AS file_types FROM fx_files GROUP BY ALL
""")
def _(v):
    # Distinct first, so a group holds no more than the few file types there are.
    kinds = v("fx_files").select("server_id", "database_name", "file_type").distinct()
    return kinds.groupBy("server_id", "database_name").agg(F.array_join(F.array_sort(F.collect_list("file_type")), ", ").alias("file_types"))


@query("number_rows_sliced", """
SELECT server_id, logical_name, database_name, row_number() OVER (PARTITION BY server_id ORDER BY size_pages DESC, logical_name, physical_name, database_name) AS position FROM fx_files
""")
def _(v):
    order = [F.col("size_pages").desc(), F.col("logical_name"), F.col("physical_name"), F.col("database_name")]
    rows = ranking.number_rows(v("fx_files"), ["server_id"], order, "position")
    return rows.select("server_id", "logical_name", "database_name", F.col("position").cast("bigint").alias("position"))


@query("read_telemetry", """
SELECT server_id, collection_time, session_id, request_id, reads, cpu FROM fx_snapshots WHERE server_id IN (1, 5)
""")
def _(v):
    root = scratch_path(v.spark, "telemetry")
    history.append_history(v("fx_snapshots"), f"{root}/snapshots", telemetry.TELEMETRY["snapshots"], "collection_time")
    rows = telemetry.read_telemetry(v.spark, root, "snapshots", since=date(2024, 1, 1), servers=[1, 5])
    return rows.select(*K, "session_id", "request_id", "reads", "cpu")
