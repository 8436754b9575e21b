"""Schemas of collected relations and of history tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "smallint": T.ShortType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "double": T.DoubleType(),
    "decimal(18,2)": T.DecimalType(18, 2),
}


def _schema(text: str) -> T.StructType:
    """``name type`` pairs to a schema; needs no running session."""
    pairs = [part.split() for part in re.split(r",\s+", text)]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_K = "server_id bigint, collection_time timestamp, "

TELEMETRY: dict[str, T.StructType] = {
    name: _schema(_K + columns)
    for name, columns in {
        "procs": "session_id bigint, request_id bigint, ecid smallint, login_time timestamp, last_batch timestamp, status string, "
        "cmd string, stmt_start bigint, stmt_end bigint, sql_handle string, host_name string, login_name string, program_name string, "
        "host_process string, database_id bigint, memory_usage bigint, open_tran bigint, wait_type string, wait_resource string, "
        "wait_time bigint, blocked bigint",
        "sessions": "session_id bigint, login_time timestamp, is_user_process boolean, last_request_start_time timestamp, "
        "last_request_end_time timestamp, logical_reads bigint, reads bigint, writes bigint, cpu_time bigint, group_id bigint",
        "requests": "session_id bigint, request_id bigint, start_time timestamp, total_elapsed_time bigint, logical_reads bigint, "
        "reads bigint, writes bigint, cpu_time bigint, plan_handle string, sql_handle string, stmt_start bigint, stmt_end bigint, "
        "transaction_id bigint, granted_query_memory bigint, percent_complete double",
        "tasks": "session_id bigint, request_id bigint, task_address bigint, worker_address bigint, task_state string, "
        "pending_io_count bigint, context_switches_count bigint",
        "workers": "worker_address bigint, thread_address bigint, runnable_time bigint",
        "threads": "thread_address bigint, usermode_time bigint, kernel_time bigint",
        "waiting_tasks": "waiting_task_address bigint, session_id bigint, blocking_session_id bigint, wait_type string, "
        "wait_duration_ms bigint, resource_description string",
        "locks": "request_session_id bigint, request_request_id bigint, resource_type string, resource_subtype string, "
        "database_name string, resource_description string, resource_associated_entity_id bigint, request_mode string, request_status string",
        "task_space": "session_id bigint, request_id bigint, user_objects_alloc_page_count bigint, internal_objects_alloc_page_count bigint, "
        "user_objects_dealloc_page_count bigint, internal_objects_dealloc_page_count bigint",
        "session_space": "session_id bigint, user_objects_alloc_page_count bigint, internal_objects_alloc_page_count bigint, "
        "user_objects_dealloc_page_count bigint, internal_objects_dealloc_page_count bigint",
        "active_tx": "transaction_id bigint, name string, transaction_begin_time timestamp",
        "db_tx": "transaction_id bigint, database_id bigint, log_record_count bigint, log_bytes_used bigint, begin_time timestamp",
        "session_tx": "transaction_id bigint, session_id bigint",
        "query_stats": "sql_handle string, plan_handle string, stmt_start bigint, stmt_end bigint, total_elapsed_time bigint, execution_count bigint",
        "cpu_records": "ts_ticks bigint, record string",
        "clock": "ms_ticks bigint",
        "replica_states": "database_id bigint, group_id bigint, is_local boolean, role string, synchronization_state string, "
        "synchronization_health string, database_state string",
        "db_files": "database_name string, logical_name string, file_type string, filegroup_name string, physical_name string, "
        "size_pages bigint, used_pages bigint, max_size_pages bigint, growth bigint, file_flags bigint, database_status string, updateability string, recovery_mode string",
        "error_events": "event_id bigint, severity bigint, error_number bigint, message string, event_time timestamp",
        "snapshots": "session_id bigint, request_id bigint, last_request_start_time timestamp, physical_io bigint, reads bigint, "
        "physical_reads bigint, writes bigint, tempdb_allocations bigint, tempdb_current bigint, context_switches bigint, "
        "used_memory bigint, max_used_memory bigint, cpu bigint, thread_cpu bigint",
    }.items()
}

HISTORY: dict[str, T.StructType] = {
    name: _schema(columns)
    for name, columns in {
        "ignored_databases": "server_id bigint, database_name string",
        "space": "server_id bigint, poll_date timestamp, database_name string, logical_name string, file_type string, "
        "filegroup_name string, physical_file_location string, space_mb decimal(18,2), used_space_mb bigint, free_space_mb decimal(18,2)",
        "cpu_usage": "server_id bigint, record_id bigint, event_time timestamp, sql_process bigint, system_idle bigint, other_process bigint",
        "database_audit": "server_id bigint, database_name string, object_name string, object_type string, action string, "
        "user_name string, audit_time timestamp",
        "temp_space": "server_id bigint, database_name string, logical_file_name string, physical_file_name string, status string, "
        "updateability string, recovery_mode string, file_size_mb bigint, space_used_mb bigint, free_space_mb bigint, "
        "free_space_pct string, max_size string, growth string, poll_date timestamp",
        "job_definitions": "server_id bigint, audit_date timestamp, job_name string, job_owner string, job_category string, "
        "job_description string, is_enabled string, job_created_on timestamp, job_last_modified_on timestamp, "
        "originating_server_name string, job_start_step_no bigint, job_start_step_name string, is_scheduled string, "
        "job_schedule_name string, job_deletion_criterion string, schedule_type string, occurrence string, recurrence string, "
        "frequency string, schedule_usage_start_date string, schedule_usage_end_date string, schedule_created_on timestamp, "
        "schedule_last_modified_on timestamp, step_no bigint, step_name string, step_type string, run_as string, database_name string, "
        "executable_command string, on_success_action string, retry_attempts bigint, retry_interval bigint, on_failure_action string",
        "sessions": "server_id bigint, elapsed_text string, session_id bigint, sql_text string, sql_command string, login_name string, "
        "wait_info string, tran_log_writes string, cpu string, tempdb_allocations string, tempdb_current string, "
        "blocking_session_id bigint, reads string, writes string, physical_reads string, query_plan string, used_memory string, "
        "status string, tran_start_time timestamp, implicit_tran string, open_tran_count string, percent_complete string, "
        "host_name string, database_name string, program_name string, start_time timestamp, login_time timestamp, request_id bigint, "
        "collection_time timestamp",
        "job_enabled_status": "server_id bigint, audit_date timestamp, replica_role string, job_id string, job_name string, is_enabled string",
        "temp_space_requests": "server_id bigint, session_id bigint, request_id bigint, tempdb_allocations bigint, "
        "tempdb_current bigint, poll_date timestamp",
        "job_history": "server_id bigint, instance_id bigint, job_id string, name string, step_id bigint, step_name string, "
        "run_date_time timestamp, run_duration string, run_status string, message string, sql_severity bigint, sql_message_id bigint, "
        "retries_attempted bigint, server string, date_added timestamp",
        "notifications": "notification_id string, server_id bigint, mail_body string, mail_format string, mail_subject string, "
        "mail_recipients string, cc_recipients string, mail_requested timestamp",
        "deliveries": "notification_id string, mail_state int, attempted_at timestamp",
        "command_log": "server_id bigint, database_name string, schema_name string, object_name string, object_type string, "
        "index_name string, index_type smallint, statistics_name string, partition_number bigint, extended_info string, command string, "
        "command_type string, start_time timestamp, end_time timestamp, error_number bigint, error_message string",
    }.items()
}
