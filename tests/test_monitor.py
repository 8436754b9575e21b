import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import deltas, filters, locks, sessions, usage, waits
from fleetscope.plans import session_monitor
from fleetscope.schemas import TELEMETRY

T = dt.datetime(2024, 1, 1, 12)
K = (1, T)


@pytest.fixture
def table(frame):
    """Rows of a declared relation; columns not given are NULL."""
    def make(name, *rows, **common):
        schema = TELEMETRY[name]
        full = []
        for row in rows:
            row = {"server_id": 1, "collection_time": T, **common, **row}
            unknown = set(row) - set(schema.fieldNames())
            assert not unknown, unknown
            full.append(tuple(row.get(f) for f in schema.fieldNames()))
        return frame(schema, full)
    return make


def proc(session, **changes):
    return {
        "session_id": session, "request_id": 0, "ecid": 0, "login_time": T - dt.timedelta(hours=2), "last_batch": T - dt.timedelta(hours=1),
        "status": "running", "cmd": "SELECT", "stmt_start": 0, "stmt_end": -1, "sql_handle": "h1", "host_name": "h", "login_name": "bob",
        "program_name": "app", "host_process": "77", "database_id": 5, "memory_usage": 2, "open_tran": 0, "wait_type": None,
        "wait_resource": None, "wait_time": 0, "blocked": 0, **changes,
    }


def test_threads_fold_into_one_request(table, rows):
    procs = table(
        "procs",
        proc(51, ecid=0, wait_type="CXPACKET", wait_time=900, wait_resource="x nodeId=1", open_tran=2),
        proc(51, ecid=1, wait_type="PAGEIOLATCH_SH", wait_time=500, wait_resource="5:1:1 (LATCH 0x1: y)", host_process=""),
        proc(51, ecid=2, wait_type="LCK_M_X", wait_time=10, wait_resource="KEY: 5", blocked=51),
        proc(51, ecid=3, wait_type="LCK_M_X", wait_time=10, wait_resource="KEY: 5", blocked=60, sql_handle="h2"),
        proc(52, status="sleeping ", request_id=3, stmt_end=0), proc(53, cmd="CREATE INDEX", stmt_start=10, stmt_end=20),
    )
    one = sessions.one_row_per_request(procs)
    got = rows(one, "session_id", "request_id", "wait_type", "wait_resource", "blocked", "sql_handle", "open_tran_count", "is_user_process")
    assert got == [
        (51, 0, "LCK_M_X", None, 60, "h2", 2, True), (52, 0, None, None, 0, "h1", 0, True), (53, 0, None, None, 0, "h1", 0, True),
    ]
    assert rows(one, "session_id", "stmt_start", "stmt_end") == [(51, 0, -1), (52, 0, -1), (53, 0, -1)]
    by_parts = sessions.primary_wait(sessions.effective_waits(sessions.fill_session(sessions.session_rollup(procs))))
    assert rows(by_parts, *sorted(one.columns)) == rows(one, *sorted(one.columns))
    assert sessions.session_rollup(procs).filter("session_id = 51 and blocked = 0").count() == 3


def test_filters_on_names_and_ids(frame, rows):
    df = frame("session_id int, program_name string, status string, open_tran_count int, host_process string, collector_session_id int", [
        (1, "App_1", "running", 0, "x", 9), (2, "AppX1", "sleeping", 1, "x", 9), (3, None, "sleeping", 0, "x", 9), (9, "me", "running", 0, "", 9),
    ])
    ids = lambda d: [i for i, in rows(d, "session_id")]
    assert ids(filters.filter_sessions(df, ("program", "app%"))) == [1, 2]
    assert ids(filters.filter_sessions(df, exclude=("program", "app_1"))) == [9]
    assert ids(filters.filter_sessions(df, ("session", 0))) == [1, 2, 3, 9]
    assert ids(filters.filter_sessions(df, ("session", ""), ("session", 2))) == [1, 3, 9]
    assert ids(filters.filter_interest(df)) == [1, 2]
    assert ids(filters.filter_interest(df, 0)) == [1]
    assert ids(filters.filter_interest(df, 2, own=True, system=True)) == [1, 2, 3, 9]
    with pytest.raises(ValueError):
        filters.filter_sessions(df, ("colour", "x"))


def test_lock_text_is_parsed(table, rows):
    row = lambda kind, text, entity=0, subtype="": {
        "request_session_id": 51, "request_request_id": 0, "resource_type": kind, "resource_subtype": subtype, "database_name": "d",
        "resource_description": text, "resource_associated_entity_id": entity, "request_mode": "X", "request_status": "GRANT",
    }
    out = locks.lock_inventory(table(
        "locks", row("OBJECT", "", 7), row("OBJECT", "", 7), row("PAGE", "1:8088", 99), row("RID", "1:511239:4", 99), row("FILE", "3"),
        row("METADATA", "object_id = 5, index_id or stats_id = 2", subtype="STATS"), row("METADATA", "schema_id = 4", subtype="SCHEMA"),
        row("METADATA", "principal_id = 6", subtype="DATABASE_PRINCIPAL"), row("APPLICATION", "0:[x]:(1)  "), row("FILE", "bad"),
        row("METADATA", "index_id or stats_id = 8", subtype="SERVER_PRINCIPAL"),
    ))
    got = {r[0:1] + (r[8],): r[1:8] + (r[9],) for r in rows(
        out, "resource_type", "object_id", "file_id", "page_type", "hobt_id", "index_id", "schema_id", "principal_id", "resource_description", "request_count")}
    assert got[("OBJECT", None)] == (7, None, None, None, None, None, None, 2)
    assert got[("PAGE", None)] == (None, 1, "PFS", 99, None, None, None, 1)
    assert got[("RID", None)] == (None, 1, "BCM", 99, None, None, None, 1)
    assert got[("FILE", None)] == (None, 3, None, None, None, None, None, 1)
    assert got[("FILE", "bad")] == (None,) * 7 + (1,)
    assert got[("METADATA.STATS", None)] == (5, None, None, None, 2, None, None, 1)
    assert got[("METADATA.SCHEMA", None)] == (None, None, None, None, None, 4, None, 1)
    assert got[("METADATA.DATABASE_PRINCIPAL", None)] == (None, None, None, None, None, None, 6, 1)
    assert got[("APPLICATION", "0:[x]:(1)")] == (None,) * 7 + (1,)
    assert got[("METADATA.SERVER_PRINCIPAL", "index_id or stats_id = 8")] == (None,) * 7 + (1,)


def test_lock_pages_hold_every_lock_group(frame, rows):
    schema = (
        "server_id int, collection_time timestamp, session_id int, request_id int, database_name string, resource_type string, object_name string, "
        "schema_name string, page_type string, index_name string, principal_name string, resource_description string, request_mode string, "
        "request_status string, request_count bigint"
    )
    data = [(*K, 51, 0, "d", "KEY", f"o{i % 7}", "s", None, f"i{i}", None, None, "X", "GRANT", 2) for i in range(25)]
    data += [(*K, 51, 0, "d", "DATABASE", None, None, None, None, None, None, "S", "GRANT", 5)] * 2
    pages = locks.lock_document(frame(schema, data), page_rows=10)
    flat = pages.select("page_no", F.explode("databases").alias("d")).select("page_no", F.explode("d.objects").alias("o")).select("page_no", F.explode("o.locks").alias("l"))
    sizes = {p: n for p, n in rows(flat.groupBy("page_no").count(), "page_no", "count")}
    assert sum(sizes.values()) == 25 and max(sizes.values()) <= 10 and len(sizes) == 3
    assert rows(flat.agg(F.sum("l.request_count").alias("n")), "n") == [(50,)]
    whole = pages.select(F.explode("databases").alias("d")).select(F.explode("d.database_locks").alias("l"))
    assert rows(whole, "l.request_mode", "l.request_count") == [("S", 2)]


def sample(session, minute, reads, **changes):
    return {
        "session_id": session, "request_id": 0, "collection_time": T + dt.timedelta(minutes=minute), "last_request_start_time": T,
        "reads": reads, "cpu": reads, "thread_cpu": 0, **changes,
    }


def test_deltas_need_two_equal_starts_and_growth(table, rows):
    data = table(
        "snapshots", sample(1, 0, 10), sample(1, 1, 15), sample(1, 1, 15), sample(2, 0, 10), sample(2, 1, 9), sample(3, 1, 5), sample(4, 0, 5),
        sample(5, 0, 1), sample(5, 1, 4, last_request_start_time=T + dt.timedelta(minutes=1)), sample(6, 0, 7), sample(6, 1, 7), sample(6, 2, 9),
        sample(7, 0, 1), sample(7, 2, 5),
    )
    out = deltas.session_deltas(data, ["reads"])
    minute = F.minute("collection_time").alias("m")
    got = {(s, m): d for s, m, d in (tuple(r) for r in out.select("session_id", minute, "reads_delta").collect())}
    assert got == {
        (1, 0): None, (1, 1): 5, (2, 0): None, (2, 1): None, (3, 1): None, (4, 0): None, (5, 0): None, (5, 1): None,
        (6, 0): None, (6, 1): 0, (6, 2): 2, (7, 0): None, (7, 2): None,
    }
    negative = deltas.session_deltas(data, ["reads"], allow_negative=True).filter("session_id = 2 and reads_delta is not null")
    assert rows(negative, "reads_delta") == [(-1,)]


def test_cpu_delta_prefers_the_larger_thread_growth(table, rows):
    data = table("snapshots", *[sample(s, m, r, thread_cpu=t) for s, m, r, t in (
        (1, 0, 10, 0), (1, 1, 12, 9), (2, 0, 10, 5), (2, 1, 12, 6), (3, 0, 10, 9), (3, 1, 8, 9), (4, 0, 9, 9), (4, 1, 7, 9),
    )])
    got = deltas.cpu_delta(data).filter(F.minute("collection_time") == 1)
    assert rows(got, "session_id", "cpu_delta") == [(1, 9), (2, 2), (3, None), (4, None)]


def test_temp_space_and_log_usage(table, rows, frame):
    task = table("task_space", {"session_id": 51, "request_id": 0, "user_objects_alloc_page_count": 5, "internal_objects_alloc_page_count": 1,
                                "user_objects_dealloc_page_count": 9, "internal_objects_dealloc_page_count": 0})
    own = table("session_space", *[{"session_id": s, "user_objects_alloc_page_count": 5, "internal_objects_alloc_page_count": 1,
                                    "user_objects_dealloc_page_count": 2, "internal_objects_dealloc_page_count": 0} for s in (51, 99)])
    known = frame("server_id bigint, collection_time timestamp, session_id bigint, request_id bigint, transaction_id bigint", [
        (*K, 51, 0, 1), (*K, 51, 1, 2), (*K, 52, 0, None),
    ])
    assert rows(usage.tempdb_usage(task, own, known), "session_id", "request_id", "tempdb_allocations", "tempdb_current") == [
        (51, -1, 6, 4), (51, 0, 6, 0),
    ]
    early, late = T - dt.timedelta(minutes=1), T + dt.timedelta(minutes=1)
    active = table("active_tx", *[{"transaction_id": i, "name": n, "transaction_begin_time": b} for i, n, b in (
        (1, "x", early), (2, "implicit_transaction", early), (3, "x", late), (4, "x", early), (5, "x", early))])
    work = table("db_tx", *[{"transaction_id": t, "database_id": d, "log_record_count": 2, "log_bytes_used": 2047, "begin_time": early} for t, d in (
        (1, 5), (1, 32767), (2, 5), (2, 6), (3, 5), (4, 7), (5, 8))])
    bound = table("session_tx", {"transaction_id": 4, "session_id": 52}, {"transaction_id": 2, "session_id": 51})
    used = usage.transaction_log_usage(active, work, bound, known)
    assert rows(used, "session_id", "request_id", "database_id", "log_kb_used", "implicit_tran") == [
        (51, 0, 5, 3, True), (51, 0, 6, 1, True), (52, 0, 7, 1, False),
    ]


@pytest.fixture
def inputs(table, frame):
    at = "server_id bigint, database_name string, "
    return {
        "procs": table("procs", proc(51, blocked=52, wait_type="LCK_M_X", wait_time=9, status="suspended"), proc(52, status="sleeping", login_name="amy"),
                       proc(53, host_process=""), proc(54, program_name="SQLAgent - TSQL JobStep (Job 0x" + "0" * 31 + "1 : Step 2)")),
        "sessions": table("sessions", *[{"session_id": s, "login_time": T - dt.timedelta(hours=2), "is_user_process": True, "reads": 4, "logical_reads": 8,
                                         "last_request_start_time": T - dt.timedelta(minutes=5), "last_request_end_time": T - dt.timedelta(hours=1)} for s in (51, 52, 54)]),
        "requests": table("requests", {"session_id": 51, "request_id": 0, "start_time": T - dt.timedelta(minutes=5), "total_elapsed_time": 5, "logical_reads": 9, "plan_handle": "p",
                                       "sql_handle": "h1", "stmt_start": 0, "stmt_end": -1, "transaction_id": 1, "granted_query_memory": 3}),
        "databases": frame("server_id bigint, collection_time timestamp, database_id bigint, name string", [(*K, 5, "d")]),
        "tasks": table("tasks", {"session_id": 51, "request_id": 0, "task_address": 1, "worker_address": 1, "task_state": "SUSPENDED", "pending_io_count": 3, "context_switches_count": 4}),
        "workers": table("workers", {"worker_address": 1, "thread_address": 1, "runnable_time": 5}),
        "threads": table("threads", {"thread_address": 1, "usermode_time": 1, "kernel_time": 2}),
        "waiting_tasks": table("waiting_tasks", {"waiting_task_address": 1, "session_id": 51, "blocking_session_id": 52, "wait_type": "LCK_M_X", "wait_duration_ms": 9,
                                                 "resource_description": "keylock hobtid=7 dbid=5 id=x"}),
        "task_space": table("task_space"), "session_space": table("session_space", {"session_id": 52, "user_objects_alloc_page_count": 5, "internal_objects_alloc_page_count": 0,
                                                                                   "user_objects_dealloc_page_count": 0, "internal_objects_dealloc_page_count": 0}),
        "active_tx": table("active_tx", {"transaction_id": 1, "name": "x", "transaction_begin_time": T}),
        "db_tx": table("db_tx", {"transaction_id": 1, "database_id": 5, "log_record_count": 2, "log_bytes_used": 3000, "begin_time": T}),
        "session_tx": table("session_tx", {"transaction_id": 1, "session_id": 51}),
        "query_stats": table("query_stats", {"sql_handle": "h1", "plan_handle": "p", "stmt_start": 0, "stmt_end": -1, "total_elapsed_time": 9999, "execution_count": 2}),
        "locks": table("locks", {"request_session_id": 51, "request_request_id": 0, "resource_type": "KEY", "resource_subtype": "", "database_name": "d", "resource_description": "(1)",
                                 "resource_associated_entity_id": 7, "request_mode": "X", "request_status": "WAIT"}),
        "alloc_units": frame(at + "allocation_unit_id bigint, type int, container_id bigint", []),
        "partitions": frame(at + "hobt_id bigint, partition_id bigint, object_id bigint, index_id bigint", [(1, "d", 7, 7, 11, 1)]),
        "objects": frame(at + "object_id bigint, name string, schema_id bigint", [(1, "d", 11, "tab", 1)]),
        "indexes": frame(at + "object_id bigint, index_id bigint, name string", [(1, "d", 11, 1, "pk")]),
        "schemas": frame(at + "schema_id bigint, name string", [(1, "d", 1, "dbo")]),
        "principals": frame(at + "principal_id bigint, name string", []),
        "sql_text": frame("server_id bigint, sql_handle string, text string", [(1, "h1", " select 1 ")]),
        "jobs": frame("server_id bigint, job_id string, name string", [(1, "00000000-0000-0000-0000-000000000001", "Nightly")]),
        "steps": frame("server_id bigint, job_id string, step_id bigint, step_name string", [(1, "00000000-0000-0000-0000-000000000001", 2, "Load")]),
        "snapshots": table("snapshots", sample(51, -1, 1), sample(51, 0, 5)),
        "collectors": frame("server_id bigint, collection_time timestamp, collector_session_id bigint", [(*K, 54)]),
    }


def test_monitor_with_every_column_group(inputs, frame, rows):
    grants = frame(
        "server_id bigint, collection_time timestamp, session_id bigint, request_id bigint, requested_memory_kb bigint, granted_memory_kb bigint, "
        "used_memory_kb bigint, max_used_memory_kb bigint", [(1, T, 51, 0, 130, 96, 64, 80)],
    )
    settings = ", ".join(f"{c} string" for c in session_monitor.SETTINGS)
    switches = ", ".join(f"{c} int" for c in sessions.SWITCHES)
    options = frame(
        f"server_id bigint, collection_time timestamp, session_id bigint, {settings}, {switches}, transaction_isolation_level int",
        [(1, T, 51, *["x"] * len(session_monitor.SETTINGS), 1, 0, None, *[1] * (len(sessions.SWITCHES) - 3), 4)],
    )
    report = session_monitor.session_snapshot({**inputs, "memory_grants": grants, "session_options": options}, session_monitor.GROUPS)
    got = {r.session_id: r for r in report.collect()}
    assert set(got) == {51, 52, 54}, "the sleeping blocker comes along, the system session does not"
    waiter, blocker, job = got[51], got[52], got[54]
    assert (waiter.is_added, blocker.is_added) == (False, True)
    assert waiter.wait_info == "(1x: 9ms)LCK_M_X" and (waiter.tasks, waiter.physical_io, waiter.thread_cpu) == (1, 3, 3)
    assert (waiter.logical_reads, blocker.logical_reads, waiter.used_memory) == (9, 8, 8), "what a grant uses replaces the session's figure"
    assert (waiter.requested_memory, waiter.granted_memory, waiter.max_used_memory, blocker.granted_memory) == (16, 12, 10, None)
    info = waiter.additional_info
    assert (info.quoted_identifier, info.arithabort, info.ansi_null_dflt_on, info.transaction_isolation_level) == ("ON", "OFF", None, "Serializable")
    assert blocker.additional_info is None and (waiter.blocked_object.lock_type, waiter.blocked_object.object_name) == ("keylock", "tab")
    assert (blocker.blocked_session_count, waiter.root_session_id, waiter.depth) == (1, 52, 1)
    assert (blocker.tempdb_allocations, waiter.tempdb_allocations) == (5, 0)
    assert (waiter.tran_log_writes, waiter.implicit_tran, waiter.avg_elapsed_ms) == ("d: 2 (2 kB),", False, 4)
    assert waiter.locks[0].objects[0].name == "tab" and waiter.locks[0].objects[0].locks[0].index_name == "pk"
    assert (waiter.sql_text, waiter.reads_delta, waiter.elapsed_ms) == ("select 1", 4, 300000)
    assert (job.job_name, job.step_name, waiter.job_name) == ("Nightly", "Load", None)
    assert waiter.start_time == T - dt.timedelta(minutes=5)


def test_a_request_with_many_waits_keeps_them_all(inputs, table):
    """More waits than a page of the summary holds; each is in the text once, the blocked one first."""
    n = 2 * waits.WAITS_PER_PAGE + 3
    common = {"waiting_task_address": 1, "session_id": 51, "blocking_session_id": 52, "wait_duration_ms": 9}
    many = [{**common, "wait_type": "LATCH_EX", "resource_description": f"R{i:05}"} for i in range(n)]
    held = {**common, "wait_type": "LCK_M_X", "resource_description": "keylock hobtid=7 dbid=5 id=x"}
    report = session_monitor.session_snapshot({**inputs, "waiting_tasks": table("waiting_tasks", *many, held)}, ("tasks",))
    waiter = next(r for r in report.collect() if r.session_id == 51)
    assert waiter.wait_info.split(", ") == ["(1x: 9ms)LCK_M_X", *[f"(1x: 9ms)LATCH_EX [R{i:05}]" for i in range(n)]]
    assert (waiter.wait_pages, waiter.tasks, waiter.physical_io, waiter.block_text) == (3, 1, 3, "keylock hobtid=7 dbid=5 id=x")


def test_summary_joins_pages_in_order_and_counts_those_with_text(frame, rows):
    totals = ", ".join(f"{c} bigint" for c in ("physical_io", "context_switches", "thread_cpu", "tasks"))
    schema = ("server_id bigint, collection_time timestamp, session_id bigint, request_id bigint, wait_type string, num_waits bigint, min_wait_ms bigint, "
              f"avg_wait_ms bigint, max_wait_ms bigint, block_text string, wait_rank int, {totals}")
    wait = lambda s, r, kind: (1, T, s, 0, kind, 1 if kind else None, 5, 5, 5, "b" if r == 1 else None, r, 1, 2, 3, 4)
    ranked = frame(schema, [*[wait(1, r, f"W{r}") for r in range(25, 0, -1)], wait(2, 1, "A"), wait(2, 2, "B"), wait(2, 3, None), wait(3, 1, None)])
    text = lambda kinds: ", ".join(f"(1x: 5ms){k}" for k in kinds)
    assert rows(waits.task_summary(ranked, page_rows=2), "session_id", "wait_info", "wait_pages", "block_text", "tasks") == [
        (1, text([f"W{r}" for r in range(1, 26)]), 13, "b", 4), (2, text("AB"), 1, "b", 4), (3, "", None, "b", 4),
    ]


def test_monitor_filters_and_joins_only_what_is_asked(inputs, rows):
    few = {k: inputs[k] for k in ("procs", "sessions", "requests", "databases", "collectors")}
    report = session_monitor.session_snapshot(few, (), exclude=("login", "amy"), own=False)
    assert rows(report, "session_id", "is_added") == [(51, False), (52, True)]
    ordered = session_monitor.order_output(report, "-session_id")
    assert [r.session_id for r in ordered.collect()] == [52, 51]
    with pytest.raises(ValueError):
        session_monitor.session_snapshot(few, ("colours",))
    with pytest.raises(ValueError):
        session_monitor.session_snapshot(few, ("blocked_objects",))


def test_blocked_object_names(inputs, rows):
    one = sessions.one_row_per_request(inputs["procs"])
    texts = waits.session_waits(inputs["waiting_tasks"], one)
    blocked = texts.select("server_id", "collection_time", F.lit(51).alias("session_id"), F.lit(0).alias("request_id"), "block_text")
    named = waits.blocked_object_names(blocked, inputs["databases"], inputs["partitions"], inputs["objects"], inputs["schemas"])
    assert rows(named, "lock_type", "schema_name", "object_name") == [("keylock", "dbo", "tab")]


def test_objects_nobody_waits_for_leave_the_catalog_before_names_are_joined(frame, rows):
    key = "server_id bigint, "
    blocked = frame(key + "collection_time timestamp, session_id bigint, request_id bigint, block_text string", [
        (1, T, 5, 0, "keylock hobtid=70 dbid=2 mode=X"), (1, T, 6, 0, "objectlock lockPartition=0 objid=8 subresource=FULL dbid=2 id=lock1"),
        (1, T, 7, 0, "keylock hobtid=71 dbid=2 mode=X"), (1, T, 8, 0, "keylock hobtid=70 dbid=3 mode=X"),
    ])
    databases = frame(key + "database_id bigint, name string", [(1, 2, "db2")])
    partitions = frame(key + "database_name string, hobt_id bigint, object_id bigint", [(1, "db2", 70, 9)])
    objects = frame(key + "database_name string, object_id bigint, name string, schema_id bigint", [
        (1, "db2", 8, "eight", 1), (1, "db2", 9, "nine", 1), (2, "db2", 9, "elsewhere", 1), *[(1, "db2", n, f"o{n}", 1) for n in range(100, 200)],
    ])
    schemas = frame(key + "database_name string, schema_id bigint, name string", [(1, "db2", 1, "dbo")])
    named = waits.blocked_object_names(blocked, databases, partitions, objects, schemas)
    assert rows(named, "session_id", "schema_name", "object_name") == sorted(
        [(5, "dbo", "nine"), (6, "dbo", "eight"), (7, None, None), (8, None, None)], key=repr
    )
    assert "LeftSemi" in named._jdf.queryExecution().optimizedPlan().toString()
