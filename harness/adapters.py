"""Telemetry-shaped views over the supplied tables.

The text is SQL that Spark and DuckDB both read, so query and comparison see the same
input. Every view covers its whole source tables.
"""

from harness import labels

ADAPTERS: dict[str, str] = {}

# ---- sessions and processes ----------------------------------------------------------

ADAPTERS["fx_sessions"] = """
SELECT event_id % 8 AS server_id,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(event_id / 40) AS BIGINT) * INTERVAL '1' MINUTE AS collection_time,
       event_id + 1 AS session_id,
       CASE WHEN event_id % 40 < 8 THEN NULL WHEN event_id % 40 < 24 THEN event_id - 7 ELSE event_id - 15 END
           AS blocking_session_id,
       CASE WHEN event_type = 'view' THEN 'sleeping' ELSE 'running' END AS status,
       event_id % 3 AS open_tran_count,
       'user' || CAST(user_id AS STRING) AS login_name,
       event_type AS program_name,
       'host' || CAST(user_id % 20 AS STRING) AS host_name,
       'db' || CAST(user_id % 12 AS STRING) AS database_name,
       CASE WHEN event_type = 'signup' THEN '' ELSE CAST(user_id AS STRING) END AS host_process,
       event_id - event_id % 40 + event_id % 8 + 1 AS collector_session_id
FROM events
"""

# Rings of three per collection; views break a ring into a chain, signups block themselves.
# Sessions that wait for one or two blockers, without cycles; every third collection has single blockers only.
ADAPTERS["fx_shared"] = """
SELECT event_id % 8 AS server_id, TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(event_id / 64) AS BIGINT) * INTERVAL '1' MINUTE AS collection_time,
       event_id + 1 AS session_id, CASE WHEN event_id % 64 >= 16 THEN event_id + 1 - 8 * (1 + event_id % 2) END AS blocking_session_id
FROM events
UNION ALL
SELECT event_id % 8, TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(event_id / 64) AS BIGINT) * INTERVAL '1' MINUTE,
       event_id + 1, CASE WHEN event_id % 64 >= 16 THEN event_id + 1 - 16 END
FROM events WHERE FLOOR(event_id / 64) % 3 <> 0 AND event_id % 5 = 0
"""
# Two rings of waiting sessions with chords, hung on each other and on a top blocker in some groups.
ADAPTERS["fx_tangle"] = """
SELECT CAST(FLOOR(event_id / 12) AS BIGINT) % 8 AS server_id,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(event_id / 12) AS BIGINT) * INTERVAL '1' MINUTE AS collection_time,
       event_id + 1 AS session_id,
       CASE WHEN event_id % 12 < 4 THEN event_id + 2
            WHEN event_id % 12 = 4 THEN event_id - 3
            WHEN event_id % 12 = 5 THEN event_id - 4
            WHEN event_id % 12 IN (6, 7) THEN event_id + 2
            WHEN event_id % 12 = 8 THEN event_id - 1
            WHEN event_id % 12 = 9 THEN event_id - 2
            WHEN event_id % 12 = 10 THEN event_id END AS blocking_session_id
FROM events
UNION ALL
SELECT CAST(FLOOR(event_id / 12) AS BIGINT) % 8, TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(event_id / 12) AS BIGINT) * INTERVAL '1' MINUTE,
       event_id + 1,
       CASE WHEN event_id % 12 = 1 AND FLOOR(event_id / 12) % 2 = 0 THEN event_id + 3
            WHEN event_id % 12 = 3 AND FLOOR(event_id / 12) % 4 = 0 THEN event_id - 2
            WHEN event_id % 12 = 6 AND FLOOR(event_id / 12) % 3 = 0 THEN event_id - 3
            WHEN event_id % 12 = 10 THEN event_id - 4
            WHEN event_id % 12 = 2 AND FLOOR(event_id / 12) % 5 = 0 THEN event_id + 10 END
FROM events
"""
ADAPTERS["fx_rings"] = """
SELECT event_id % 8 AS server_id,
       TIMESTAMP '2024-01-01 00:00:00' + CAST(FLOOR(event_id / 24) AS BIGINT) * INTERVAL '1' MINUTE AS collection_time,
       event_id + 1 AS session_id,
       CASE WHEN event_type = 'view' THEN NULL
            WHEN event_type = 'signup' THEN event_id + 1
            WHEN event_id % 24 < 16 THEN event_id + 9 ELSE event_id - 15 END AS blocking_session_id
FROM events
"""

ADAPTERS["fx_procs"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time,
       user_id AS session_id, event_id % 2 AS request_id, event_id % 4 AS ecid,
       TIMESTAMP '2024-01-01 00:00:00' + user_id * INTERVAL '1' MINUTE AS login_time,
       CAST(ts AS TIMESTAMP) AS last_batch,
       CASE WHEN event_type = 'view' THEN 'sleeping  ' ELSE 'Running  ' END AS status,
       CASE WHEN event_type = 'signup' THEN 'CREATE INDEX' ELSE upper(event_type) END AS cmd,
       (event_id % 50) * 2 AS stmt_start,
       CASE WHEN event_id % 7 = 0 THEN 0 ELSE (event_id % 50) * 2 + 20 END AS stmt_end,
       CASE WHEN event_type = 'click' THEN NULL ELSE 'h' || CAST(event_id % 20 AS STRING) END AS sql_handle,
       'host' || CAST(user_id % 20 AS STRING) AS host_name,
       'user' || CAST(user_id AS STRING) || '  ' AS login_name,
       event_type AS program_name,
       CASE WHEN event_type = 'click' THEN '' ELSE CAST(user_id + 1000 AS STRING) END AS host_process,
       user_id % 12 + 1 AS database_id, event_id % 100 AS memory_usage, event_id % 3 AS open_tran,
       CASE event_type WHEN 'error' THEN 'LCK_M_X' WHEN 'purchase' THEN 'PAGEIOLATCH_SH'
                       WHEN 'click' THEN 'CXPACKET' WHEN 'signup' THEN 'LATCH_EX' END AS wait_type,
       CASE event_type WHEN 'error' THEN 'keylock hobtid=' || CAST(user_id AS STRING) || ' dbid=' || CAST(user_id % 12 + 1 AS STRING) || ' mode=X'
                       WHEN 'purchase' THEN CAST(user_id % 12 + 1 AS STRING) || ':1:' || CAST((event_id % 5) * 8088 AS STRING)
                       WHEN 'click' THEN 'exchangeEvent id=Port1 nodeId=' || CAST(event_id % 4 AS STRING) || ' waitType=e_waitPipeNewRow'
                       WHEN 'signup' THEN 'ACCESS_METHODS_' || CAST(event_id % 3 AS STRING) || ' (LATCH 0x00: Class: X)' END AS wait_resource,
       event_id % 1000 AS wait_time,
       CASE WHEN event_type = 'error' THEN (user_id + 16) % 152 WHEN event_type = 'signup' THEN user_id ELSE 0 END AS blocked
FROM events
"""

ADAPTERS["fx_live_sessions"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, user_id AS session_id,
       TIMESTAMP '2024-01-01 00:00:00' + user_id * INTERVAL '1' MINUTE AS login_time,
       user_id % 5 <> 0 AS is_user_process,
       CAST(min(ts) AS TIMESTAMP) AS last_request_start_time, CAST(min(ts) AS TIMESTAMP) AS last_request_end_time,
       CAST(sum(event_id) AS BIGINT) AS logical_reads, count(*) AS reads, min(event_id) AS writes, max(event_id) AS cpu_time,
       user_id % 4 AS group_id
FROM events GROUP BY user_id, date_trunc('week', ts)
"""

ADAPTERS["fx_requests"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, user_id AS session_id,
       event_id % 2 AS request_id, CAST(min(ts) AS TIMESTAMP) AS start_time,
       max(event_id) % 100000 AS total_elapsed_time, max(event_id) AS logical_reads, min(event_id) AS reads,
       count(*) AS writes, CAST(sum(event_id) AS BIGINT) AS cpu_time, 'p' || CAST(user_id % 20 AS STRING) AS plan_handle,
       'h' || CAST(user_id % 20 AS STRING) AS sql_handle, (user_id % 50) * 2 AS stmt_start,
       CAST(-1 AS BIGINT) AS stmt_end, max(event_id) AS transaction_id, user_id % 3 AS granted_query_memory,
       CAST(user_id % 4 AS DOUBLE) AS percent_complete
FROM events GROUP BY user_id, event_id % 2, date_trunc('week', ts)
"""

ADAPTERS["fx_query_stats"] = """
SELECT user_id % 8 AS server_id, 'h' || CAST(user_id % 20 AS STRING) AS sql_handle,
       'p' || CAST(user_id % 20 AS STRING) AS plan_handle, (user_id % 50) * 2 AS stmt_start,
       CAST(-1 AS BIGINT) AS stmt_end, CAST(sum(event_id) * 1000 AS BIGINT) AS total_elapsed_time, count(*) AS execution_count
FROM events GROUP BY user_id % 8, user_id % 20, user_id % 50
"""

# ---- tasks and waits -----------------------------------------------------------------

ADAPTERS["fx_tasks"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, user_id AS session_id,
       CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 2 END AS request_id,
       event_id AS task_address, event_id AS worker_address,
       CASE WHEN event_type = 'purchase' THEN 'RUNNABLE' ELSE 'SUSPENDED' END AS task_state,
       event_id % 7 AS pending_io_count, event_id % 11 AS context_switches_count
FROM events
"""
ADAPTERS["fx_workers"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, event_id AS worker_address,
       event_id AS thread_address, event_id % 50 AS runnable_time
FROM events
"""
ADAPTERS["fx_threads"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, event_id AS thread_address,
       event_id % 100 AS usermode_time, event_id % 10 AS kernel_time
FROM events
"""
ADAPTERS["fx_waiting_tasks"] = """
SELECT server_id, collection_time, event_id AS waiting_task_address, session_id,
       blocked AS blocking_session_id, wait_type, wait_time AS wait_duration_ms, wait_resource AS resource_description
FROM (SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, event_id, user_id AS session_id,
             CASE WHEN event_type = 'error' THEN (user_id + 16) % 152 END AS blocked,
             CASE event_type WHEN 'error' THEN 'LCK_M_X' WHEN 'purchase' THEN 'PAGEIOLATCH_SH'
                             WHEN 'click' THEN 'CXPACKET' WHEN 'signup' THEN 'LATCH_EX' ELSE 'WRITELOG' END AS wait_type,
             event_id % 1000 AS wait_time,
             CASE event_type WHEN 'error' THEN 'keylock hobtid=' || CAST(user_id AS STRING) || ' dbid=' || CAST(user_id % 12 + 1 AS STRING) || ' mode=X'
                             WHEN 'purchase' THEN CAST(user_id % 12 + 1 AS STRING) || ':1:' || CAST((event_id % 5) * 8088 AS STRING)
                             WHEN 'click' THEN 'exchangeEvent id=Port1 nodeId=' || CAST(event_id % 4 AS STRING) || ' waitType=e_waitPipeNewRow'
                             WHEN 'signup' THEN 'ACCESS_METHODS_' || CAST(event_id % 3 AS STRING) || ' (LATCH 0x00: Class: X)' END AS wait_resource
      FROM events) AS e
"""
ADAPTERS["fx_db_names"] = """
SELECT user_id % 8 AS server_id, date_trunc('week', ts) AS collection_time, user_id % 12 + 1 AS database_id,
       'db' || CAST(user_id % 12 + 1 AS STRING) AS name
FROM events GROUP BY user_id % 8, date_trunc('week', ts), user_id % 12
"""

# ---- snapshots -----------------------------------------------------------------------

ADAPTERS["fx_snapshots"] = """
SELECT l_orderkey % 8 AS server_id,
       TIMESTAMP '2024-01-01 00:00:00' + (l_linenumber * 60 + l_linenumber * l_linenumber % 5) * INTERVAL '1' SECOND AS collection_time,
       l_orderkey AS session_id, CAST(0 AS BIGINT) AS request_id,
       CASE WHEN l_orderkey % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00'
            ELSE CAST(date_trunc('month', min(l_shipdate)) AS TIMESTAMP) END AS last_request_start_time,
       CAST(round(min(l_extendedprice) * 100) AS BIGINT) AS physical_io, CAST(min(l_quantity) AS BIGINT) AS reads,
       min(l_partkey) AS physical_reads, min(l_suppkey) AS writes,
       CAST(round(min(l_discount) * 100) AS BIGINT) AS tempdb_allocations,
       CAST(round(min(l_tax) * 100) AS BIGINT) AS tempdb_current,
       min(l_partkey) % 97 AS context_switches, min(l_partkey) % 13 AS used_memory, min(l_suppkey) % 17 AS max_used_memory,
       min(l_partkey) % 1000 AS cpu, min(l_suppkey) % 1000 AS thread_cpu
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

# ---- locks and their catalog ---------------------------------------------------------

ADAPTERS["fx_locks"] = """
SELECT l_suppkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time,
       l_suppkey AS request_session_id, CAST(0 AS BIGINT) AS request_request_id,
       CASE l_linenumber WHEN 1 THEN 'OBJECT' WHEN 2 THEN 'PAGE' WHEN 3 THEN 'KEY' WHEN 4 THEN 'METADATA'
                         WHEN 5 THEN 'DATABASE' WHEN 6 THEN 'APPLICATION' ELSE 'ALLOCATION_UNIT' END AS resource_type,
       CASE WHEN l_linenumber <> 4 THEN '' WHEN l_linestatus = 'O' THEN 'STATS' ELSE 'DATABASE_PRINCIPAL' END AS resource_subtype,
       'db' || CAST(l_suppkey % 5 AS STRING) AS database_name,
       CASE WHEN l_linenumber = 2 THEN '1:' || CAST((l_partkey % 4) * 8088 + l_partkey % 9 AS STRING)
            WHEN l_linenumber = 3 THEN '(' || CAST(l_partkey AS STRING) || ')'
            WHEN l_linenumber = 4 AND l_linestatus = 'O' THEN 'object_id = ' || CAST(l_partkey AS STRING) || ', index_id or stats_id = 4'
            WHEN l_linenumber = 4 THEN 'principal_id = ' || CAST(l_partkey % 25 AS STRING)
            WHEN l_linenumber = 6 THEN '0:[app' || CAST(l_partkey % 40 AS STRING) || ']:(5cfc)  '
            ELSE '' END AS resource_description,
       CASE WHEN l_linenumber = 1 THEN l_partkey WHEN l_linenumber IN (2, 3) THEN l_suppkey
            WHEN l_linenumber = 7 THEN l_partkey ELSE 0 END AS resource_associated_entity_id,
       l_returnflag AS request_mode, l_linestatus AS request_status
FROM lineitem
"""
ADAPTERS["fx_lock_sessions"] = """
SELECT s_suppkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END AS session_id,
       CAST(0 AS BIGINT) AS request_id, TIMESTAMP '2024-01-30 23:00:00' + s_nationkey * INTERVAL '1' MINUTE AS start_time
FROM supplier
"""
ADAPTERS["fx_objects"] = """
SELECT DISTINCT l_suppkey % 8 AS server_id, 'db' || CAST(l_suppkey % 5 AS STRING) AS database_name,
       CASE WHEN p_brand <> 'Brand#13' THEN p_partkey ELSE -p_partkey END AS object_id, p_name || CAST(p_partkey AS STRING) AS name, p_size % 7 AS schema_id
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
ADAPTERS["fx_catalog_indexes"] = """
SELECT DISTINCT l_suppkey % 8 AS server_id, 'db' || CAST(l_suppkey % 5 AS STRING) AS database_name,
       l_partkey AS object_id, l_linenumber AS index_id, 'ix_' || CAST(l_partkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS name
FROM lineitem
"""
ADAPTERS["fx_schemas"] = """
SELECT DISTINCT l_suppkey % 8 AS server_id, 'db' || CAST(l_suppkey % 5 AS STRING) AS database_name,
       p_size % 7 AS schema_id, 'schema' || CAST(p_size % 7 AS STRING) AS name
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
ADAPTERS["fx_principals"] = """
SELECT DISTINCT s_suppkey % 8 AS server_id, 'db' || CAST(s_suppkey % 5 AS STRING) AS database_name,
       CAST(s_nationkey AS BIGINT) AS principal_id, 'principal' || CAST(s_nationkey AS STRING) AS name
FROM supplier
"""
ADAPTERS["fx_partitions"] = """
SELECT s_suppkey % 8 AS server_id, 'db' || CAST(s_suppkey % 5 AS STRING) AS database_name, s_suppkey AS hobt_id,
       s_suppkey + 1000000 AS partition_id, s_suppkey AS object_id, 1 + s_suppkey % 7 AS index_id
FROM supplier
"""
ADAPTERS["fx_alloc_units"] = """
SELECT l_suppkey % 8 AS server_id, 'db' || CAST(l_suppkey % 5 AS STRING) AS database_name,
       l_partkey AS allocation_unit_id, 1 + l_partkey % 3 AS type,
       CASE WHEN l_partkey % 3 = 1 THEN min(l_suppkey) + 1000000 ELSE min(l_suppkey) END AS container_id
FROM lineitem GROUP BY l_suppkey % 8, l_suppkey % 5, l_partkey
"""

# ---- transactions and temp space -----------------------------------------------------

ADAPTERS["fx_active_tx"] = """
SELECT o_orderkey % 8 AS server_id, TIMESTAMP '2001-06-01 00:00:00' AS collection_time, o_orderkey AS transaction_id,
       CASE WHEN o_orderstatus = 'P' THEN 'implicit_transaction' ELSE 'user_transaction' END AS name,
       CAST(o_orderdate AS TIMESTAMP) AS transaction_begin_time
FROM orders
"""
ADAPTERS["fx_db_tx"] = """
SELECT l_orderkey % 8 AS server_id, TIMESTAMP '2001-06-01 00:00:00' AS collection_time, l_orderkey AS transaction_id,
       CASE WHEN l_suppkey % 25 = 24 THEN 32767 ELSE l_suppkey % 25 END AS database_id,
       count(*) AS log_record_count, CAST(sum(CAST(FLOOR(l_extendedprice) AS BIGINT)) AS BIGINT) AS log_bytes_used,
       CAST(min(l_shipdate) AS TIMESTAMP) AS begin_time
FROM lineitem GROUP BY l_orderkey, l_suppkey % 25
"""
ADAPTERS["fx_session_tx"] = """
SELECT o_orderkey % 8 AS server_id, TIMESTAMP '2001-06-01 00:00:00' AS collection_time, o_orderkey AS transaction_id,
       CASE WHEN o_orderstatus <> 'F' THEN o_custkey ELSE -o_custkey END AS session_id
FROM orders
"""
ADAPTERS["fx_tx_sessions"] = """
SELECT o_orderkey % 8 AS server_id, TIMESTAMP '2001-06-01 00:00:00' AS collection_time, o_custkey AS session_id,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS request_id, max(o_orderkey) AS transaction_id
FROM orders GROUP BY o_orderkey % 8, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END
"""
ADAPTERS["fx_task_space"] = """
SELECT l_suppkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, l_suppkey AS session_id,
       CAST(l_linenumber % 2 AS BIGINT) AS request_id, CAST(l_quantity AS BIGINT) AS user_objects_alloc_page_count,
       l_partkey % 30 AS internal_objects_alloc_page_count, l_partkey % 60 AS user_objects_dealloc_page_count,
       l_orderkey % 25 AS internal_objects_dealloc_page_count
FROM lineitem
"""
ADAPTERS["fx_session_space"] = """
SELECT o_custkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, o_custkey AS session_id,
       o_orderkey % 50 AS user_objects_alloc_page_count, o_orderkey % 7 AS internal_objects_alloc_page_count,
       o_orderkey % 60 AS user_objects_dealloc_page_count, o_orderkey % 5 AS internal_objects_dealloc_page_count
FROM orders
"""

# ---- CPU records ---------------------------------------------------------------------

ADAPTERS["fx_cpu"] = """
SELECT event_id % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, event_id * 200 AS ts_ticks,
       '<Record id="' || CAST(event_id AS STRING) || '" type="RING_BUFFER_SCHEDULER_MONITOR"><SchedulerMonitorEvent>'
       || CASE WHEN event_type = 'signup' THEN '<Other>' ELSE '<SystemHealth>' END
       || '<ProcessUtilization>' || CAST(event_id % 10 AS STRING) || '</ProcessUtilization><SystemIdle>'
       || CAST(event_id % 90 AS STRING) || '</SystemIdle></x></SchedulerMonitorEvent></Record>' AS record
FROM events
"""
ADAPTERS["fx_clock"] = """
SELECT event_id % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, max(event_id) * 200 + 1000 AS ms_ticks
FROM events GROUP BY event_id % 8
"""
ADAPTERS["fx_cpu_history"] = """
SELECT event_id % 8 AS server_id, event_id AS record_id, CAST(ts AS TIMESTAMP) AS event_time,
       event_id % 10 AS sql_process, event_id % 90 AS system_idle, 100 - event_id % 90 - event_id % 10 AS other_process
FROM events WHERE event_type = 'view'
"""

# ---- scheduled jobs ------------------------------------------------------------------

ADAPTERS["fx_jobs"] = """
SELECT p_partkey % 8 AS server_id, 'job' || CAST(p_partkey AS STRING) AS job_id, p_name || CAST(p_partkey AS STRING) AS name,
       CAST(p_partkey % 2 AS INT) AS enabled, p_size % 27 AS owner_sid, p_size % 5 AS category_id,
       CASE WHEN p_size = 9 THEN NULL ELSE 'Runs ' || p_type END AS description, CAST(p_partkey % 4 AS INT) AS delete_level,
       TIMESTAMP '2023-01-01 00:00:00' + (p_partkey % 300) * INTERVAL '1' DAY AS date_created,
       TIMESTAMP '2023-02-01 00:00:00' + (p_partkey % 300) * INTERVAL '1' DAY AS date_modified, p_size % 6 AS originating_server_id
FROM part
"""
ADAPTERS["fx_steps"] = """
SELECT l_partkey % 8 AS server_id, 'job' || CAST(l_partkey AS STRING) AS job_id, l_linenumber AS step_id,
       'Step ' || CAST(l_linenumber AS STRING) AS step_name,
       CASE min(l_returnflag) WHEN 'A' THEN 'TSQL' WHEN 'N' THEN 'CmdExec' ELSE 'Custom' END AS subsystem,
       'EXEC step' || CAST(l_linenumber AS STRING) AS command, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name,
       l_linenumber % 4 + 1 AS on_success_action, l_linenumber + 1 AS on_success_step_id,
       (l_linenumber + 2) % 4 + 1 AS on_fail_action, l_linenumber - 1 AS on_fail_step_id,
       l_linenumber % 3 AS retry_attempts, l_linenumber % 5 AS retry_interval, CAST(min(l_suppkey) % 30 AS INT) AS proxy_id
FROM lineitem GROUP BY l_partkey, l_linenumber
"""
ADAPTERS["fx_job_dims"] = """
SELECT DISTINCT p_partkey % 8 AS server_id, n_nationkey, n_name, n_regionkey FROM part JOIN nation ON p_size % 25 = n_nationkey
"""
ADAPTERS["fx_schedules"] = """
SELECT server_id, n_nationkey AS schedule_id, 'Schedule ' || n_name AS name,
       CASE n_nationkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 32 WHEN 5 THEN 64 ELSE 128 END AS freq_type,
       n_nationkey * 5 % 127 + 1 AS freq_interval,
       CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS freq_subday_type,
       n_nationkey + 1 AS freq_subday_interval,
       CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END AS freq_relative_interval,
       n_nationkey % 3 + 1 AS freq_recurrence_factor, 20240100 + n_nationkey + 1 AS active_start_date, 99991231 AS active_end_date,
       n_nationkey * 100 AS active_start_time, 235959 AS active_end_time,
       TIMESTAMP '2023-05-01 00:00:00' AS date_created, TIMESTAMP '2023-06-01 00:00:00' AS date_modified
FROM fx_job_dims
"""
ADAPTERS["fx_job_schedules"] = """
SELECT p_partkey % 8 AS server_id, CASE WHEN p_brand <> 'Brand#13' THEN 'job' ELSE 'other' END || CAST(p_partkey AS STRING) AS job_id, p_size % 25 AS schedule_id
FROM part
"""
ADAPTERS["fx_job_view"] = f"""
SELECT j.server_id, j.job_id, j.name AS job_name, o.n_name AS job_owner, 'category' || CAST(c.n_regionkey AS STRING) AS job_category,
       j.description AS job_description, {labels.case('j.enabled', labels.ENABLED)} AS is_enabled,
       j.date_created AS job_created_on, j.date_modified AS job_last_modified_on, v.name AS originating_server_name,
       s.step_id AS job_start_step_no, s.step_name AS job_start_step_name,
       CASE WHEN h.schedule_id IS NULL THEN 'No' ELSE 'Yes' END AS is_scheduled, h.name AS job_schedule_name,
       {labels.case('j.delete_level', labels.DELETION)} AS job_deletion_criterion,
       {labels.case('h.freq_type', {k: 'Recurring' if k in labels.RECURRING else t for k, t in labels.OCCURRENCE.items()})} AS schedule_type,
       {labels.case('h.freq_type', labels.OCCURRENCE)} AS occurrence,
       h.freq_type, h.freq_interval, h.freq_subday_type, h.freq_subday_interval, h.freq_relative_interval, h.freq_recurrence_factor,
       h.active_start_date, h.active_end_date, h.active_start_time, h.active_end_time,
       h.date_created AS schedule_created_on, h.date_modified AS schedule_last_modified_on,
       s.step_id AS step_no, s.step_name, s.subsystem, x.n_name AS run_as, s.database_name, s.command AS executable_command,
       s.on_success_action AS success_code, s.on_success_step_id, ss.step_name AS success_name,
       s.on_fail_action AS fail_code, s.on_fail_step_id, fs.step_name AS fail_name, s.retry_attempts, s.retry_interval
FROM fx_jobs j
LEFT JOIN (SELECT DISTINCT server_id, n_regionkey, 'server' || CAST(n_regionkey AS STRING) AS name FROM fx_job_dims) v
  ON v.server_id = j.server_id AND v.n_regionkey = j.originating_server_id
LEFT JOIN (SELECT DISTINCT server_id, n_regionkey FROM fx_job_dims) c ON c.server_id = j.server_id AND c.n_regionkey = j.category_id
LEFT JOIN fx_job_dims o ON o.server_id = j.server_id AND o.n_nationkey = j.owner_sid
LEFT JOIN fx_steps s ON s.server_id = j.server_id AND s.job_id = j.job_id
LEFT JOIN fx_steps ss ON ss.server_id = j.server_id AND ss.job_id = j.job_id AND ss.step_id = s.on_success_step_id
LEFT JOIN fx_steps fs ON fs.server_id = j.server_id AND fs.job_id = j.job_id AND fs.step_id = s.on_fail_step_id
LEFT JOIN fx_job_dims x ON x.server_id = j.server_id AND x.n_nationkey = s.proxy_id
LEFT JOIN fx_job_schedules js ON js.server_id = j.server_id AND js.job_id = j.job_id
LEFT JOIN fx_schedules h ON h.server_id = js.server_id AND h.schedule_id = js.schedule_id
"""

# ---- databases, replicas, backups ----------------------------------------------------

ADAPTERS["fx_databases"] = """
SELECT c_custkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, c_custkey AS database_id,
       CASE WHEN c_custkey < 8 THEN 'master' ELSE c_name END AS name, c_nationkey,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'OFFLINE' ELSE 'ONLINE' END AS state,
       CASE c_nationkey % 3 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'FULL' ELSE 'BULK_LOGGED' END AS recovery_model,
       CASE WHEN c_nationkey = 7 THEN 'SINGLE_USER' ELSE 'MULTI_USER' END AS user_access, c_nationkey <> 7 OR c_acctbal > 0 AS is_accessible,
       c_nationkey = 11 AS in_standby, c_nationkey = 12 AS is_read_only, c_nationkey = 13 AS is_distributor,
       CASE WHEN c_nationkey = 14 THEN c_custkey END AS source_database_id,
       CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_custkey * 10 END AS log_lsn,
       CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE c_custkey * 9 END AS differential_base_lsn,
       c_nationkey = 16 AS differential_base_is_snapshot, c_custkey * 100 AS allocated_pages, c_custkey * c_nationkey AS modified_pages,
       c_custkey * 120 AS database_pages, CASE WHEN c_nationkey = 17 THEN NULL ELSE c_custkey % 1000 END AS log_size_mb,
       CASE WHEN c_nationkey = 18 THEN NULL ELSE TIMESTAMP '2024-01-30 23:00:00' + (c_custkey % 3600) * INTERVAL '1' SECOND END AS last_log_backup,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'group' || CAST(c_custkey % 8 AS STRING) || CASE WHEN c_nationkey % 3 = 0 THEN 'b' ELSE 'a' END END AS availability_group,
       c_mktsegment <> 'MACHINERY' AS in_group,
       CASE c_nationkey % 4 WHEN 0 THEN 'SECONDARY' WHEN 1 THEN NULL ELSE 'PRIMARY' END AS replica_role,
       CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS is_preferred_replica,
       CASE WHEN c_nationkey = 19 THEN 'PRIMARY' END AS log_shipping_role, 'NO' AS secondary_connections,
       'SRV' || CAST(c_custkey % 8 AS STRING) AS server_name, CASE WHEN c_custkey % 8 > 3 THEN 'INST' END AS instance_name,
       CASE WHEN c_custkey % 8 > 5 THEN 'CLUSTER' END AS cluster_name
FROM customer
"""
ADAPTERS["fx_replica_states"] = """
SELECT c_custkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time,
       CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey ELSE -c_custkey END AS database_id,
       c_custkey % 8 AS group_id, c_nationkey <> 20 AS is_local,
       CASE WHEN c_custkey % 8 < 3 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
       CASE c_nationkey % 4 WHEN 0 THEN 'SYNCHRONIZING' ELSE 'SYNCHRONIZED' END AS synchronization_state,
       CASE c_nationkey % 6 WHEN 0 THEN 'PARTIALLY_HEALTHY' WHEN 1 THEN 'NOT_HEALTHY' ELSE 'HEALTHY' END AS synchronization_health,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'OFFLINE' ELSE 'ONLINE' END AS database_state
FROM customer
"""
ADAPTERS["fx_groups"] = """
SELECT DISTINCT c_custkey % 8 AS server_id, c_custkey % 8 AS group_id, 'ag' || CAST(c_custkey % 8 % 3 AS STRING) AS name FROM customer
"""
# Groups as the databases name them, several on a server.
ADAPTERS["fx_database_groups"] = """
SELECT DISTINCT server_id, availability_group AS name FROM fx_databases WHERE availability_group IS NOT NULL
"""
ADAPTERS["fx_ignored"] = """
SELECT c_custkey % 8 AS server_id, c_name AS database_name FROM customer WHERE c_nationkey = 3
"""
ADAPTERS["fx_backups"] = """
SELECT o_custkey % 8 AS server_id, CASE WHEN o_custkey < 8 THEN 'master' ELSE c_name END AS database_name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'D' WHEN '2-HIGH' THEN 'I' ELSE 'L' END AS type,
       CAST(o_orderdate AS TIMESTAMP) AS backup_start_date, o_orderkey AS last_lsn, o_orderstatus = 'P' AS is_damaged
FROM orders JOIN customer ON o_custkey = c_custkey
"""
ADAPTERS["fx_policies"] = """
SELECT server_id, policy_id, CASE
         WHEN policy_id = 0 THEN 'USER_DATABASES,-Customer#0000001%, -%7'
         WHEN policy_id = 1 THEN 'ALL_DATABASES'
         WHEN policy_id = 2 THEN ' [Customer#000000042] , Customer#00000099_,AVAILABILITY_GROUP_DATABASES,-SYSTEM_DATABASES, Nowhere'
         WHEN policy_id = 3 THEN 'SYSTEM_DATABASES,Customer#%9,nobody,-%19'
         ELSE NULL END AS spec,
       CASE policy_id WHEN 0 THEN 'FULL' WHEN 1 THEN 'LOG' WHEN 2 THEN 'DIFF' ELSE 'LOG' END AS backup_type,
       policy_id <> 3 AS change_backup_type, CASE WHEN policy_id = 2 THEN 15 END AS modification_level, policy_id = 4 AS copy_only,
       CASE policy_id WHEN 3 THEN 'READ_WRITE' ELSE 'ALL' END AS updateability,
       CASE WHEN policy_id = 1 THEN 500 END AS log_size_threshold_mb, CASE WHEN policy_id = 1 THEN 1800 END AS log_time_threshold_s,
       CAST(CASE policy_id WHEN 1 THEN 4 ELSE 2 END AS INT) AS directory_count, CAST(CASE policy_id WHEN 2 THEN 4 END AS INT) AS number_of_files,
       CAST(CASE policy_id WHEN 2 THEN 20 END AS BIGINT) AS min_size_for_multiple_mb, CAST(CASE policy_id WHEN 0 THEN 10 END AS BIGINT) AS max_file_size_mb,
       CAST(CASE WHEN policy_id IN (0, 1) THEN 24 END AS INT) AS cleanup_hours,
       CASE policy_id WHEN 0 THEN 'ALL' WHEN 1 THEN 'PRIMARY' WHEN 2 THEN 'PREFERRED_BACKUP_REPLICA' ELSE 'SECONDARY' END AS replica_scope,
       policy_id <> 2 AS checks_secondaries, CASE policy_id WHEN 0 THEN 'CHECKDB' ELSE 'CHECKALLOC, CHECKCATALOG,CHECKTABLE' END AS check_commands
FROM (SELECT DISTINCT c_custkey % 8 AS server_id, c_nationkey % 5 AS policy_id FROM customer) AS p
"""

# ---- indexes, files, errors, commands ------------------------------------------------

ADAPTERS["fx_memory_grants"] = """
SELECT DISTINCT server_id, collection_time, session_id, CASE WHEN status LIKE 'sleeping%' THEN 0 ELSE request_id END AS request_id,
       session_id * 67 AS requested_memory_kb, session_id * 51 AS granted_memory_kb, session_id * 43 AS max_used_memory_kb, session_id * 41 AS used_memory_kb
FROM fx_procs WHERE session_id % 3 <> 0
"""
ADAPTERS["fx_session_options"] = """
SELECT DISTINCT server_id, collection_time, session_id, 4096 + session_id AS text_size, CASE WHEN session_id % 5 = 0 THEN 'Deutsch' ELSE 'us_english' END AS language,
       CASE WHEN session_id % 5 = 0 THEN 'dmy' ELSE 'mdy' END AS date_format, 7 - session_id % 7 AS date_first, session_id % 4 - 1 AS lock_timeout,
       session_id % 11 - 5 AS deadlock_priority, session_id * 3 AS row_count, CAST(session_id % 2 = 0 AS INT) AS quoted_identifier, CAST(session_id % 3 = 0 AS INT) AS arithabort,
       CAST(session_id % 5 <> 0 AS INT) AS ansi_null_dflt_on, CAST(session_id % 7 = 0 AS INT) AS ansi_defaults, CAST(session_id % 2 = 1 AS INT) AS ansi_warnings, CAST(session_id % 3 <> 0 AS INT) AS ansi_padding,
       CASE WHEN session_id % 13 <> 0 THEN CAST(session_id % 4 = 0 AS INT) END AS ansi_nulls, CAST(session_id % 9 = 0 AS INT) AS concat_null_yields_null, session_id % 7 AS transaction_isolation_level
FROM fx_procs WHERE session_id % 10 <> 9
"""
ADAPTERS["fx_db_filegroups"] = """
SELECT server_id, name AS database_name, 'PRIMARY' AS filegroup_name FROM fx_databases
UNION ALL SELECT server_id, name, 'FG' || CAST(database_id % 3 AS STRING) FROM fx_databases
"""
ADAPTERS["fx_db_objects"] = """
SELECT server_id, name AS database_name, 'dbo' AS schema_name, 't' || CAST(database_id % 4 AS STRING) AS object_name FROM fx_databases
UNION ALL SELECT server_id, name, 'dbo', 't2_' || CAST(database_id % 2 AS STRING) FROM fx_databases
UNION ALL SELECT server_id, name, 'app', 'orders' FROM fx_databases WHERE database_id % 2 = 0
"""
ADAPTERS["fx_indexes"] = """
SELECT l_partkey % 8 AS server_id, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name,
       'schema' || CAST(p_size % 3 AS STRING) AS schema_name, 'part' || CAST(l_partkey AS STRING) AS object_name, l_partkey AS object_id,
       CAST(l_linenumber AS BIGINT) AS index_id, 'ix_' || CAST(l_linenumber AS STRING) AS index_name,
       CAST(1 + l_linenumber % 7 AS INT) AS index_type, l_partkey % 9 <> 0 AS allow_page_locks, p_size % 11 = 0 AS is_image_text,
       p_size % 5 = 0 AS is_new_lob, p_size % 13 = 0 AS is_file_stream, p_size % 17 = 0 AS is_column_store, p_size % 19 = 0 AS is_memory_optimized,
       p_size % 23 = 0 AS on_read_only_filegroup, l_partkey % 41 = 0 AND l_linenumber = 2 AS resumable,
       CAST(l_linenumber AS BIGINT) AS statistics_id, 'ix_' || CAST(l_linenumber AS STRING) AS statistics_name, p_size % 2 = 0 AS is_incremental,
       l_suppkey % 3 + 1 AS partition_number
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_partkey, l_linenumber, p_size, l_suppkey % 3
UNION ALL
SELECT p_partkey % 8, 'db' || CAST(p_partkey % 5 AS STRING), 'schema' || CAST(p_size % 3 AS STRING), 'part' || CAST(p_partkey AS STRING), p_partkey,
       CAST(1 + p_partkey % 7 AS BIGINT), 'whole', CAST(1 + p_partkey % 5 AS INT), p_partkey % 9 <> 0, p_size % 11 = 0, p_size % 5 = 0, p_size % 13 = 0,
       p_size % 17 = 0, p_size % 19 = 0, p_size % 23 = 0, FALSE, CAST(1 + p_partkey % 7 AS BIGINT), 'whole', p_size % 2 = 0, CAST(NULL AS BIGINT)
FROM part
"""
ADAPTERS["fx_index_physical"] = """
SELECT l_partkey % 8 AS server_id, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name, l_partkey AS object_id,
       CAST(l_linenumber AS BIGINT) AS index_id, l_suppkey % 3 + 1 AS partition_number,
       CASE WHEN l_returnflag = 'R' AND l_tax > 0.05 THEN 'LOB_DATA' ELSE 'IN_ROW_DATA' END AS alloc_unit_type,
       CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS index_level,
       CAST(l_quantity AS BIGINT) * 100 AS page_count, CAST(l_partkey % 60 AS DOUBLE) AS fragmentation
FROM lineitem
"""
ADAPTERS["fx_stats_props"] = """
SELECT l_partkey % 8 AS server_id, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name, l_partkey AS object_id,
       CAST(l_linenumber AS BIGINT) AS statistics_id, count(*) * 1000 AS row_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS modification_counter
FROM lineitem GROUP BY l_partkey, l_linenumber
"""
ADAPTERS["fx_column_stats"] = """
SELECT l_partkey % 8 AS server_id, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name, l_partkey AS object_id,
       CAST(l_suppkey % 15 AS BIGINT) AS statistics_id, 'st_' || CAST(l_suppkey % 15 AS STRING) AS statistics_name
FROM lineitem
"""
ADAPTERS["fx_column_statistics"] = """
SELECT l_partkey % 8 AS server_id, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name, 'schema' || CAST(p_size % 3 AS STRING) AS schema_name,
       'part' || CAST(l_partkey AS STRING) AS object_name, l_partkey AS object_id, p_size % 19 = 0 AS is_memory_optimized,
       CAST(l_suppkey % 15 AS BIGINT) AS statistics_id, 'st_' || CAST(l_suppkey % 15 AS STRING) AS statistics_name, l_suppkey % 3 = 0 AS is_incremental
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_partkey, l_suppkey, p_size
"""
ADAPTERS["fx_incremental_props"] = """
SELECT server_id, database_name, object_id, statistics_id, partition_number, CAST(count(*) * 1000 AS BIGINT) AS row_count, CAST(sum(changes) AS BIGINT) AS modification_counter
FROM (
  SELECT l_partkey % 8 AS server_id, 'db' || CAST(l_partkey % 5 AS STRING) AS database_name, l_partkey AS object_id,
         CAST(l_linenumber AS BIGINT) AS statistics_id, l_suppkey % 3 + 1 AS partition_number, CAST(l_quantity AS BIGINT) AS changes
  FROM lineitem
  UNION ALL
  SELECT l_partkey % 8, 'db' || CAST(l_partkey % 5 AS STRING), l_partkey, CAST(l_suppkey % 15 AS BIGINT), CAST(l_quantity AS BIGINT) % 3 + 1, CAST(l_quantity AS BIGINT) * 4
  FROM lineitem WHERE l_suppkey % 3 = 0 AND l_suppkey % 15 > 7) parts
GROUP BY server_id, database_name, object_id, statistics_id, partition_number
"""
ADAPTERS["fx_statistics_policies"] = """
SELECT server_id, policy_id,
       CASE policy_id WHEN 1 THEN 'ALL_INDEXES,-%.%.%.st_9' WHEN 2 THEN 'db1.schema1.%,db2.%.part1%.st_1%' END AS spec,
       CASE policy_id WHEN 0 THEN 'ALL' ELSE 'COLUMNS' END AS update_statistics, policy_id = 2 AS only_modified_statistics,
       CAST(CASE policy_id WHEN 1 THEN 3 END AS INT) AS statistics_modification_level, policy_id <> 1 AS partition_level_statistics
FROM (SELECT DISTINCT p_partkey % 8 AS server_id, p_size % 3 AS policy_id FROM part) AS p
"""
ADAPTERS["fx_index_policies"] = """
SELECT server_id, policy_id,
       CASE policy_id WHEN 0 THEN 'ALL_INDEXES,-db1.%.%' WHEN 1 THEN 'db0.schema1.part%.ix_2,[db2].[schema0].[part1%],-%.%.%9.%' ELSE NULL END AS spec,
       CASE policy_id WHEN 0 THEN 'ALL' WHEN 1 THEN 'INDEX' END AS update_statistics, policy_id = 1 AS only_modified_statistics,
       CAST(CASE policy_id WHEN 2 THEN 5 END AS INT) AS statistics_modification_level,
       CASE policy_id WHEN 2 THEN 'INDEX_REORGANIZE' END AS fragmentation_low,
       CASE policy_id WHEN 1 THEN 'INDEX_REBUILD_ONLINE,INDEX_REORGANIZE' WHEN 2 THEN 'INDEX_REORGANIZE' ELSE 'INDEX_REORGANIZE,INDEX_REBUILD_ONLINE,INDEX_REBUILD_OFFLINE' END AS fragmentation_medium,
       CASE policy_id WHEN 2 THEN 'INDEX_REORGANIZE' ELSE 'INDEX_REBUILD_ONLINE, INDEX_REBUILD_OFFLINE' END AS fragmentation_high
FROM (SELECT DISTINCT p_partkey % 8 AS server_id, p_size % 3 AS policy_id FROM part) AS p
"""
ADAPTERS["fx_files"] = """
SELECT l_suppkey % 8 AS server_id, TIMESTAMP '2024-01-31 00:00:00' AS collection_time, 'db' || CAST(l_suppkey % 25 AS STRING) AS database_name,
       'file' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS logical_name,
       CASE l_returnflag WHEN 'A' THEN 'ROWS' WHEN 'N' THEN 'LOG' ELSE 'FILESTREAM' END AS file_type,
       CASE WHEN l_returnflag = 'A' THEN 'PRIMARY' END AS filegroup_name, 'D:/data/' || CAST(l_partkey AS STRING) AS physical_name,
       CAST(l_quantity AS BIGINT) * 1280 + l_partkey % 128 AS size_pages,
       CAST(FLOOR((CAST(l_quantity AS BIGINT) * 1280 + l_partkey % 128) * (10 - l_linenumber) / 10) AS BIGINT) AS used_pages,
       CASE WHEN l_linestatus = 'O' THEN -1 ELSE CAST(l_quantity AS BIGINT) * 12800 END AS max_size_pages,
       l_partkey % 1000 AS growth, CASE WHEN l_suppkey % 3 = 0 THEN 1048578 ELSE 2 END AS file_flags,
       'ONLINE' AS database_status, CASE WHEN l_linestatus = 'O' THEN 'READ_WRITE' ELSE 'READ_ONLY' END AS updateability, 'SIMPLE' AS recovery_mode
FROM lineitem
"""
ADAPTERS["fx_errors"] = """
SELECT event_id % 4 AS server_id, event_id, 15 + event_id % 12 AS severity, 823 + event_id % 4 AS error_number,
       'Error of user ' || CAST(user_id AS STRING) AS message, CAST(ts AS TIMESTAMP) AS event_time
FROM events WHERE event_type = 'error'
"""
# A storm: all events of a server within days, so cooldowns chain over many alerts.
ADAPTERS["fx_storm"] = """
SELECT event_id % 2 AS server_id, event_id, 16 + event_id % 3 AS severity, CAST(0 AS BIGINT) AS error_number,
       event_type AS message, TIMESTAMP '2024-01-01 00:00:00' + (event_id * 7 % 100000) * INTERVAL '1' SECOND AS event_time
FROM events
"""
ADAPTERS["fx_commands"] = """
SELECT o_custkey % 8 AS server_id, c_name AS database_name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'DBCC_CHECKDB' WHEN '2-HIGH' THEN 'BACKUP_LOG' ELSE 'ALTER_INDEX' END AS command_type,
       CAST(o_orderdate AS TIMESTAMP) AS start_time,
       CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + (o_orderkey * 37 % 200000) * INTERVAL '1' SECOND END AS end_time,
       CASE WHEN o_orderstatus = 'P' AND o_custkey % 10 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 1205 WHEN o_orderstatus = 'F' AND o_custkey % 9 = 0 THEN 50000 ELSE 0 END AS error_number
FROM orders JOIN customer ON o_custkey = c_custkey
"""
