"""Queries on sessions, blocking, waits, locks and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.functions.statements import active_statement, last_request_start, request_start_time
from fleetscope.keys import K, SK
from fleetscope.operators import deltas, filters, graph, locks, ranking, sessions, usage, waits
from fleetscope.plans import session_monitor
from fleetscope.runtime import cut_lineage
from harness.core import query

# ---- blocking graph ------------------------------------------------------------------


def _chains_sql(view: str) -> str:
    return f"""
WITH RECURSIVE nodes AS (
  SELECT s.server_id, s.collection_time, s.session_id, b.session_id AS blocker
  FROM {view} s LEFT JOIN {view} b
    ON b.server_id = s.server_id AND b.collection_time = s.collection_time
   AND b.session_id = s.blocking_session_id AND s.blocking_session_id <> s.session_id),
down AS (
  SELECT server_id, collection_time, session_id AS top, session_id AS here, [session_id] AS path FROM nodes
  UNION ALL
  SELECT d.server_id, d.collection_time, d.top, n.session_id, list_append(d.path, n.session_id)
  FROM down d JOIN nodes n ON n.server_id = d.server_id AND n.collection_time = d.collection_time AND n.blocker = d.here
  WHERE NOT list_contains(d.path, n.session_id)),
up AS (
  SELECT server_id, collection_time, session_id, session_id AS here, blocker AS above, 0 AS hops, [session_id] AS path FROM nodes
  UNION ALL
  SELECT u.server_id, u.collection_time, u.session_id, n.session_id, n.blocker, u.hops + 1, list_append(u.path, n.session_id)
  FROM up u JOIN nodes n ON n.server_id = u.server_id AND n.collection_time = u.collection_time AND n.session_id = u.above
  WHERE NOT list_contains(u.path, n.session_id)),
counts AS (SELECT server_id, collection_time, top AS session_id, count(*) - 1 AS n FROM down GROUP BY ALL),
tops AS (SELECT server_id, collection_time, session_id, hops, here FROM up WHERE above IS NULL),
chains AS (
  SELECT c.server_id, c.collection_time, c.session_id, CAST(c.n AS BIGINT) AS blocked_session_count,
         CAST(t.hops AS BIGINT) AS depth, t.here AS root_session_id
  FROM counts c LEFT JOIN tops t USING (server_id, collection_time, session_id))
"""


@query("blocking_chains", _chains_sql("fx_sessions") + "SELECT * FROM chains")
def _(v):
    return graph.blocking_chains(v("fx_sessions"))


@query("blocking_chains_rings", _chains_sql("fx_rings") + "SELECT * FROM chains")
def _(v):
    return graph.blocking_chains(v("fx_rings"))


_SHARED_SQL = """
WITH RECURSIVE edges AS (SELECT DISTINCT server_id, collection_time, session_id, blocking_session_id AS blocker FROM fx_shared WHERE blocking_session_id IS NOT NULL),
down AS (
  SELECT server_id, collection_time, blocker AS top, session_id AS here FROM edges
  UNION ALL
  SELECT d.server_id, d.collection_time, d.top, e.session_id FROM down d JOIN edges e
    ON e.server_id = d.server_id AND e.collection_time = d.collection_time AND e.blocker = d.here),
counts AS (SELECT server_id, collection_time, top AS session_id, count(*) AS n FROM down GROUP BY ALL),
up AS (
  SELECT DISTINCT server_id, collection_time, session_id, session_id AS here, 0 AS depth FROM fx_shared
  UNION
  SELECT u.server_id, u.collection_time, u.session_id, e.blocker, u.depth + 1 FROM up u JOIN edges e
    ON e.server_id = u.server_id AND e.collection_time = u.collection_time AND e.session_id = u.here),
tops AS (
  SELECT u.server_id, u.collection_time, u.session_id, u.depth, u.here,
         row_number() OVER (PARTITION BY u.server_id, u.collection_time, u.session_id ORDER BY u.depth, u.here) AS r
  FROM up u WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.server_id = u.server_id AND e.collection_time = u.collection_time AND e.session_id = u.here)),
chains AS (
  SELECT t.server_id, t.collection_time, t.session_id, CAST(coalesce(c.n, 0) AS BIGINT) AS blocked_session_count,
         CAST(t.depth AS BIGINT) AS depth, t.here AS root_session_id
  FROM tops t LEFT JOIN counts c USING (server_id, collection_time, session_id) WHERE t.r = 1)
"""


@query("blocking_chains_multi", _SHARED_SQL + "SELECT * FROM chains")
def _(v):
    return graph.blocking_chains(v("fx_shared"))


@query("blocking_chains_tangled", """
WITH RECURSIVE nodes AS (SELECT DISTINCT server_id, collection_time, session_id FROM fx_tangle),
edges AS (
  SELECT DISTINCT f.server_id, f.collection_time, f.session_id, f.blocking_session_id AS blocker
  FROM fx_tangle f JOIN nodes n ON n.server_id = f.server_id AND n.collection_time = f.collection_time AND n.session_id = f.blocking_session_id
  WHERE f.blocking_session_id <> f.session_id),
reach AS (
  SELECT server_id, collection_time, session_id, blocker AS here FROM edges
  UNION
  SELECT r.server_id, r.collection_time, r.session_id, e.blocker FROM reach r JOIN edges e
    ON e.server_id = r.server_id AND e.collection_time = r.collection_time AND e.session_id = r.here),
named AS (
  SELECT n.server_id, n.collection_time, n.session_id, least(n.session_id, coalesce(min(r.here), n.session_id)) AS strong
  FROM nodes n LEFT JOIN (
    SELECT a.* FROM reach a JOIN reach b ON b.server_id = a.server_id AND b.collection_time = a.collection_time AND b.session_id = a.here AND b.here = a.session_id) r
    USING (server_id, collection_time, session_id)
  GROUP BY n.server_id, n.collection_time, n.session_id),
sizes AS (SELECT server_id, collection_time, strong, count(*) AS size FROM named GROUP BY ALL),
arcs AS (
  SELECT e.server_id, e.collection_time, c.strong AS below, b.strong AS above
  FROM edges e JOIN named c USING (server_id, collection_time, session_id)
  JOIN named b ON b.server_id = e.server_id AND b.collection_time = e.collection_time AND b.session_id = e.blocker
  WHERE c.strong <> b.strong),
down AS (
  SELECT server_id, collection_time, strong AS top, strong AS here FROM sizes
  UNION ALL
  SELECT d.server_id, d.collection_time, d.top, a.below FROM down d JOIN arcs a
    ON a.server_id = d.server_id AND a.collection_time = d.collection_time AND a.above = d.here),
worth AS (
  SELECT d.server_id, d.collection_time, d.top AS strong, sum(s.size) AS worth
  FROM down d JOIN sizes s ON s.server_id = d.server_id AND s.collection_time = d.collection_time AND s.strong = d.here GROUP BY ALL),
up AS (
  SELECT server_id, collection_time, session_id, session_id AS here, 0 AS depth FROM nodes
  UNION
  SELECT u.server_id, u.collection_time, u.session_id, e.blocker, u.depth + 1 FROM up u JOIN edges e
    ON e.server_id = u.server_id AND e.collection_time = u.collection_time AND e.session_id = u.here WHERE u.depth < 12),
tops AS (
  SELECT u.server_id, u.collection_time, u.session_id, min_by(u.here, (u.depth, u.here)) AS root, min(u.depth) AS depth
  FROM up u ANTI JOIN edges e ON e.server_id = u.server_id AND e.collection_time = u.collection_time AND e.session_id = u.here GROUP BY ALL)
SELECT n.server_id, n.collection_time, n.session_id, CAST(w.worth - 1 AS BIGINT) AS blocked_session_count, CAST(t.depth AS BIGINT) AS depth, t.root AS root_session_id
FROM named n JOIN worth w USING (server_id, collection_time, strong) LEFT JOIN tops t USING (server_id, collection_time, session_id)
""")
def _(v):
    return graph.blocking_chains(v("fx_tangle"))


@query("descendant_counts", _SHARED_SQL + "SELECT server_id, collection_time, session_id, blocked_session_count FROM chains WHERE depth = 0 AND blocked_session_count > 0")
def _(v):
    return graph.descendant_counts(v("fx_shared"))


@query("block_leaders", _chains_sql("fx_sessions") + "SELECT * FROM chains WHERE depth = 0 AND blocked_session_count > 0")
def _(v):
    return graph.block_leaders(graph.blocking_chains(v("fx_sessions")))


@query("blocker_counts", """
SELECT server_id, collection_time, blocking_session_id AS session_id, count(*) AS directly_blocked
FROM fx_sessions WHERE blocking_session_id IS NOT NULL GROUP BY ALL
""")
def _(v):
    return graph.block_edges(v("fx_sessions")).groupBy(*K, F.col("blocker").alias("session_id")).agg(
        F.count(F.lit(1)).alias("directly_blocked")
    )


@query("blocker_closure", """
WITH RECURSIVE kept AS (SELECT server_id, collection_time, session_id, blocking_session_id FROM fx_sessions WHERE program_name = 'purchase'),
walk AS (
  SELECT * FROM kept
  UNION
  SELECT s.server_id, s.collection_time, s.session_id, s.blocking_session_id
  FROM walk w JOIN fx_sessions s ON s.server_id = w.server_id AND s.collection_time = w.collection_time
   AND s.session_id = w.blocking_session_id)
SELECT w.server_id, w.collection_time, w.session_id, k.session_id IS NULL AS is_added
FROM walk w LEFT JOIN kept k USING (server_id, collection_time, session_id)
""")
def _(v):
    everything = v("fx_sessions")
    kept = filters.filter_sessions(everything, include=("program", "purchase"))
    return graph.blocker_closure(kept, everything).select(*K, "session_id", "is_added")


@query("except_missing", """
SELECT server_id, collection_time, blocking_session_id AS session_id FROM fx_sessions
WHERE program_name = 'error' AND blocking_session_id IS NOT NULL
EXCEPT
SELECT server_id, collection_time, session_id FROM fx_sessions WHERE program_name = 'error'
""")
def _(v):
    return graph.missing_blockers(filters.filter_sessions(v("fx_sessions"), include=("program", "error")))


# ---- filters -------------------------------------------------------------------------


@query("filter_sessions", """
SELECT server_id, collection_time, session_id, login_name, host_name FROM fx_sessions
WHERE lower(login_name) LIKE 'user1%' AND NOT lower(host_name) LIKE 'host_'
""")
def _(v):
    kept = filters.filter_sessions(v("fx_sessions"), include=("login", "USER1%"), exclude=("host", "host_"))
    return kept.select(*K, "session_id", "login_name", "host_name")


@query("filter_interest", """
SELECT server_id, collection_time, session_id, status, open_tran_count FROM fx_sessions
WHERE (status <> 'sleeping' OR open_tran_count > 0) AND session_id <> collector_session_id AND host_process <> ''
""")
def _(v):
    return filters.filter_interest(v("fx_sessions")).select(*K, "session_id", "status", "open_tran_count")


@query("expand_blockers_or_all", """
SELECT server_id, collection_time, session_id, bool_or(program_name = 'error') AS is_blocker FROM fx_sessions
WHERE program_name = 'error' OR server_id IN (1, 2) GROUP BY ALL
""")
def _(v):
    everything = v("fx_sessions")
    named = everything.filter("program_name = 'error'").select(*K, "session_id")
    marker = everything.filter("server_id in (1, 2)").select(*K, F.lit(0).cast("bigint").alias("session_id"))
    return filters.expand_blockers_or_all(everything, named.unionByName(marker)).select(*K, "session_id", "is_blocker")


# ---- rollup and primary wait ---------------------------------------------------------

ROLLUP_SQL = """
rollup AS (
  SELECT server_id, collection_time, session_id,
         CASE WHEN rtrim(status) = 'sleeping' THEN 0 ELSE request_id END AS request_id,
         rtrim(wait_type) AS wait_type, rtrim(regexp_replace(wait_resource, ' [(]LATCH .*$', '')) AS wait_resource,
         CASE WHEN blocked = session_id THEN 0 ELSE blocked END AS blocked,
         max(wait_time) AS wait_time, max(login_time) AS login_time, max(last_batch) AS last_request_end_time,
         max(stmt_start) AS stmt_start, max(stmt_end) AS stmt_end, max(sql_handle) AS sql_handle,
         max(database_id) AS database_id, max(memory_usage) AS memory_usage, max(open_tran) AS open_tran_count,
         max(rtrim(status)) AS status, max(rtrim(cmd)) AS cmd, max(rtrim(host_name)) AS host_name,
         max(rtrim(login_name)) AS login_name, max(rtrim(program_name)) AS program_name,
         max(rtrim(host_process)) AS host_process, bool_or(host_process <> '') AS is_user_process
  FROM fx_procs GROUP BY ALL)
"""
FILLED_SQL = ROLLUP_SQL + """,
filled AS (
  SELECT * REPLACE (
    max(sql_handle) OVER w AS sql_handle, max(login_name) OVER w AS login_name,
    max(memory_usage) OVER w AS memory_usage, max(open_tran_count) OVER w AS open_tran_count)
  FROM rollup WINDOW w AS (PARTITION BY server_id, collection_time, session_id, request_id))
"""
PRIMARY_SQL = FILLED_SQL + """,
effective AS (
  SELECT * REPLACE (
    lower(status) AS status,
    CASE WHEN cmd = 'CREATE INDEX' THEN 0 ELSE stmt_start END AS stmt_start,
    CASE WHEN cmd = 'CREATE INDEX' OR stmt_end = 0 THEN -1 ELSE stmt_end END AS stmt_end,
    CASE WHEN wait_time > 0 AND wait_type <> 'CXPACKET' THEN wait_type END AS wait_type,
    CASE WHEN wait_time > 0 AND wait_type <> 'CXPACKET' THEN wait_resource END AS wait_resource,
    CASE WHEN wait_type <> 'CXPACKET' THEN wait_time ELSE 0 END AS wait_time)
  FROM filled),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY server_id, collection_time, session_id, request_id
      ORDER BY CASE WHEN wait_type LIKE 'LCK%' THEN 1 ELSE 99 END, wait_time DESC, blocked DESC,
               wait_type DESC NULLS LAST, wait_resource DESC NULLS LAST, last_request_end_time DESC,
               stmt_start DESC, stmt_end DESC, cmd DESC, program_name DESC) AS r
  FROM effective),
picked AS (
  SELECT * EXCLUDE (r) REPLACE (
    CASE WHEN wait_type LIKE 'PAGE%LATCH%' OR wait_type LIKE 'LATCH%' THEN wait_resource END AS wait_resource)
  FROM numbered WHERE r = 1)
"""


@query("session_rollup", "WITH " + ROLLUP_SQL + "SELECT * FROM rollup")
def _(v):
    return sessions.session_rollup(v("fx_procs"))


@query("fill_session", "WITH " + FILLED_SQL + """
SELECT server_id, collection_time, session_id, request_id, wait_type, wait_resource, blocked,
       sql_handle, login_name, memory_usage, open_tran_count FROM filled
""")
def _(v):
    filled = sessions.fill_session(sessions.session_rollup(v("fx_procs")))
    return filled.select(*SK, "wait_type", "wait_resource", "blocked", "sql_handle", "login_name", "memory_usage", "open_tran_count")


@query("primary_wait", "WITH " + PRIMARY_SQL + "SELECT * FROM picked")
def _(v):
    return sessions.one_row_per_request(v("fx_procs"))


@query("session_number", """
SELECT server_id, collection_time, session_id, dense_rank() OVER (PARTITION BY server_id, collection_time ORDER BY session_id) AS session_number
FROM fx_procs
""")
def _(v):
    return sessions.session_number(v("fx_procs")).select(*K, "session_id", F.col("session_number").cast("bigint").alias("session_number"))


_REQUEST_SQL = PRIMARY_SQL + """,
joined AS (
  SELECT p.*, s.is_user_process AS session_is_user, s.last_request_start_time AS session_request_start,
         coalesce(r.logical_reads, s.logical_reads) AS logical_reads, coalesce(r.reads, s.reads) AS reads,
         coalesce(r.writes, s.writes) AS writes, coalesce(r.cpu_time, s.cpu_time) AS cpu_time,
         r.start_time AS request_start, r.plan_handle, coalesce(r.sql_handle, p.sql_handle) AS active_sql_handle,
         coalesce(r.stmt_start, p.stmt_start) AS active_stmt_start, coalesce(r.stmt_end, p.stmt_end) AS active_stmt_end,
         r.transaction_id
  FROM picked p
  LEFT JOIN fx_live_sessions s ON s.server_id = p.server_id AND s.collection_time = p.collection_time
   AND s.session_id = p.session_id AND s.login_time = p.login_time
  LEFT JOIN fx_requests r ON p.status <> 'sleeping' AND r.server_id = p.server_id AND r.collection_time = p.collection_time
   AND r.session_id = p.session_id AND r.request_id = p.request_id
   AND ((NOT s.is_user_process AND NOT p.is_user_process)
        OR (r.start_time = s.last_request_start_time AND s.last_request_end_time <= p.last_request_end_time)))
"""
_REQUEST_COLUMNS = (
    "server_id, collection_time, session_id, request_id, session_is_user, logical_reads, reads, writes, cpu_time, "
    "request_start, plan_handle, active_sql_handle, active_stmt_start, active_stmt_end, transaction_id"
)


def _requests(v):
    return sessions.session_request_join(sessions.one_row_per_request(v("fx_procs")), v("fx_live_sessions"), v("fx_requests"))


@query("session_request_join", "WITH " + _REQUEST_SQL + f"SELECT {_REQUEST_COLUMNS} FROM joined")
def _(v):
    return _requests(v).selectExpr(*[c.strip() for c in _REQUEST_COLUMNS.split(",")])


@query("average_runtime", "WITH " + _REQUEST_SQL + """
SELECT j.server_id, j.collection_time, j.session_id, j.request_id,
       (q.total_elapsed_time // q.execution_count) // 1000 AS avg_elapsed_ms
FROM joined j LEFT JOIN fx_query_stats q ON q.server_id = j.server_id AND q.sql_handle = j.active_sql_handle
 AND q.plan_handle = j.plan_handle AND q.stmt_start = j.active_stmt_start AND q.stmt_end = j.active_stmt_end
""")
def _(v):
    shaped = _requests(v).select(
        *SK, F.col("active_sql_handle").alias("sql_handle"), "plan_handle",
        F.col("active_stmt_start").alias("stmt_start"), F.col("active_stmt_end").alias("stmt_end"),
    )
    return sessions.average_runtime(shaped, v("fx_query_stats")).select(*SK, "avg_elapsed_ms")


@query("session_options", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'OFF' WHEN 1 THEN 'ON' END AS quoted_identifier, CASE WHEN user_id % 2 = 0 THEN 'OFF' ELSE 'ON' END AS arithabort,
       CASE event_id % 7 WHEN 0 THEN 'Unspecified' WHEN 1 THEN 'ReadUncomitted' WHEN 2 THEN 'ReadCommitted' WHEN 3 THEN 'Repeatable' WHEN 4 THEN 'Serializable' WHEN 5 THEN 'Snapshot' END AS transaction_isolation_level
FROM events
""")
def _(v):
    return sessions.session_options(v("events").select(
        "event_id", (F.col("event_id") % 3).alias("quoted_identifier"), (F.col("user_id") % 2).alias("arithabort"),
        (F.col("event_id") % 7).alias("transaction_isolation_level"),
    ))


def _elsewhere(rows, condition: str):
    """``rows``, those that miss the condition moved to sessions that do not exist, so lookups find nothing."""
    return rows.withColumn("session_id", F.when(F.expr(condition), F.col("session_id")).otherwise(-1 - F.col("session_id")))


@query("top1_lookup", """
SELECT t.server_id, t.collection_time, t.task_address, t.session_id, s.request_start
FROM fx_tasks t JOIN (
  SELECT server_id, collection_time, session_id, start_time AS request_start,
         row_number() OVER (PARTITION BY server_id, collection_time, session_id ORDER BY start_time DESC, request_id DESC) AS r
  FROM (SELECT * REPLACE (CASE WHEN request_id = 1 THEN session_id ELSE -1 - session_id END AS session_id) FROM fx_requests)) s
  USING (server_id, collection_time, session_id) WHERE s.r = 1
""")
def _(v):
    lookup = _elsewhere(v("fx_requests"), "request_id = 1").withColumnRenamed("start_time", "request_start")
    found = sessions.top1_lookup(
        v("fx_tasks"), lookup, [*K, "session_id"], [F.col("request_start"), F.col("request_id")], ["request_start"]
    )
    return found.select(*K, "task_address", "session_id", "request_start")


@query("outer_top1_lookup", """
SELECT t.server_id, t.collection_time, t.task_address, t.session_id, s.request_start
FROM fx_tasks t LEFT JOIN (
  SELECT server_id, collection_time, session_id, max(start_time) AS request_start
  FROM (SELECT * REPLACE (CASE WHEN request_id = 1 THEN session_id ELSE -1 - session_id END AS session_id) FROM fx_requests) GROUP BY ALL) s USING (server_id, collection_time, session_id)
""")
def _(v):
    lookup = _elsewhere(v("fx_requests"), "request_id = 1").withColumnRenamed("start_time", "request_start")
    found = sessions.top1_lookup(
        v("fx_tasks"), lookup, [*K, "session_id"], [F.col("request_start"), F.col("request_id")], ["request_start"], how="left"
    )
    return found.select(*K, "task_address", "session_id", "request_start")


@query("update_from", """
SELECT l.server_id, l.collection_time, l.session_id, coalesce(r.logical_reads, l.logical_reads) AS logical_reads
FROM fx_live_sessions l LEFT JOIN (
  SELECT server_id, collection_time, session_id, arg_max(logical_reads, request_id) AS logical_reads
  FROM (SELECT * REPLACE (CASE WHEN granted_query_memory > 0 THEN session_id ELSE -1 - session_id END AS session_id) FROM fx_requests) GROUP BY ALL) r USING (server_id, collection_time, session_id)
""")
def _(v):
    patched = sessions.update_from(
        v("fx_live_sessions"), _elsewhere(v("fx_requests"), "granted_query_memory > 0"), [*K, "session_id"],
        ["logical_reads"], [F.col("request_id")],
    )
    return patched.select(*K, "session_id", "logical_reads")


@query("memory_grant_chain", """
WITH grants AS (SELECT server_id, collection_time, session_id, request_id, CAST(sum(granted_query_memory) AS BIGINT) AS granted_kb,
                       session_id % 4 AS pool_id, session_id % 2 AS resource_semaphore_id FROM fx_requests GROUP BY ALL),
sems AS (SELECT server_id, collection_time, session_id % 4 AS pool_id, session_id % 2 AS resource_semaphore_id, count(*) AS grantee_count
         FROM fx_requests GROUP BY ALL),
grps AS (SELECT DISTINCT server_id, collection_time, group_id, group_id % 2 AS group_pool_id, 'group' || CAST(group_id AS STRING) AS group_name FROM fx_live_sessions),
pools AS (SELECT DISTINCT server_id, collection_time, CASE WHEN group_id > 1 THEN group_id % 2 ELSE -1 END AS pool_id, 'pool' || CAST(group_id % 2 AS STRING) AS pool_name FROM fx_live_sessions)
SELECT s.server_id, s.collection_time, s.session_id, CAST(r.request_id AS BIGINT) AS request_id, g.granted_kb, m.grantee_count, w.group_name, p.pool_name
FROM fx_live_sessions s JOIN fx_requests r USING (server_id, collection_time, session_id)
LEFT JOIN grants g USING (server_id, collection_time, session_id, request_id)
LEFT JOIN sems m ON m.server_id = s.server_id AND m.collection_time = s.collection_time AND m.pool_id = g.pool_id AND m.resource_semaphore_id = g.resource_semaphore_id
LEFT JOIN grps w ON w.server_id = s.server_id AND w.collection_time = s.collection_time AND w.group_id = s.group_id
LEFT JOIN pools p ON p.server_id = s.server_id AND p.collection_time = s.collection_time AND p.pool_id = w.group_pool_id
""")
def _(v):
    requests, live = v("fx_requests"), v("fx_live_sessions")
    pool, sem = (F.col("session_id") % 4).alias("pool_id"), (F.col("session_id") % 2).alias("resource_semaphore_id")
    grants = requests.groupBy(*SK).agg(F.sum("granted_query_memory").alias("granted_kb")).select("*", pool, sem)
    semaphores = requests.groupBy(*K, pool, sem).agg(F.count(F.lit(1)).alias("grantee_count"))
    groups = live.select(
        *K, "group_id", (F.col("group_id") % 2).alias("group_pool_id"),
        F.concat(F.lit("group"), F.col("group_id").cast("string")).alias("group_name"),
    ).distinct()
    pools = live.select(
        *K, F.when(F.col("group_id") > 1, F.col("group_id") % 2).otherwise(-1).alias("pool_id"), F.concat(F.lit("pool"), (F.col("group_id") % 2).cast("string")).alias("pool_name")
    ).distinct()
    base = live.select(*K, "session_id", "group_id").join(requests.select(*SK), [*K, "session_id"])
    return sessions.memory_grant_chain(base, grants, semaphores, groups, pools).select(
        *SK, "granted_kb", "grantee_count", "group_name", "pool_name"
    )


# ---- waits ---------------------------------------------------------------------------

_TASKS_SQL = PRIMARY_SQL + """,
active AS (
  SELECT t.*, CASE WHEN t.task_state = 'RUNNABLE' AND w.runnable_time > 0 THEN w.runnable_time END AS runnable_time,
         h.usermode_time + h.kernel_time AS thread_cpu_time
  FROM fx_tasks t
  JOIN picked p ON p.server_id = t.server_id AND p.collection_time = t.collection_time AND p.session_id = t.session_id
   AND p.request_id = t.request_id AND p.status <> 'sleeping'
  LEFT JOIN fx_workers w ON w.server_id = t.server_id AND w.collection_time = t.collection_time AND w.worker_address = t.worker_address
  LEFT JOIN fx_threads h ON h.server_id = t.server_id AND h.collection_time = t.collection_time AND h.thread_address = w.thread_address)
"""
_PAGE = "CAST(regexp_extract(res, ':([0-9]+)$', 1) AS BIGINT)"
_WAITS_SQL = _TASKS_SQL + f""",
totals AS (
  SELECT server_id, collection_time, session_id, request_id, sum(pending_io_count) AS physical_io,
         sum(context_switches_count) AS context_switches, sum(thread_cpu_time) AS thread_cpu, count(*) AS tasks
  FROM active GROUP BY ALL),
firsts AS (
  SELECT server_id, collection_time, session_id, blocked, wait_type AS own_wait,
         row_number() OVER (PARTITION BY server_id, collection_time, session_id ORDER BY request_id DESC, blocked DESC) AS r FROM picked),
raw AS (
  SELECT w.*, rtrim(regexp_replace(w.resource_description, ' [(]LATCH .*$', '')) AS res, f.blocked, d.name AS db
  FROM fx_waiting_tasks w
  JOIN firsts f ON f.r = 1 AND f.server_id = w.server_id AND f.collection_time = w.collection_time AND f.session_id = w.session_id
   AND coalesce(f.own_wait, '') <> 'OLEDB'
  LEFT JOIN fx_db_names d ON d.server_id = w.server_id AND d.collection_time = w.collection_time
   AND d.database_id = TRY_CAST(split_part(w.resource_description, ':', 1) AS BIGINT)
  WHERE w.wait_type <> 'OLEDB'),
texts AS (
  SELECT DISTINCT server_id, collection_time, waiting_task_address, wait_duration_ms,
         wait_type || CASE
           WHEN wait_type LIKE 'PAGE%LATCH%' THEN ':' || coalesce(db, '(null)') || ':' || split_part(res, ':', 2) || '(' ||
                CASE WHEN {_PAGE} = 1 OR {_PAGE} % 8088 = 0 THEN 'PFS' ELSE '*' END || ')'
           WHEN wait_type = 'CXPACKET' THEN ':' || regexp_extract(res, 'nodeId=([^ ]*)', 1)
           WHEN wait_type LIKE 'LATCH%' THEN ' [' || res || ']'
           ELSE '' END AS wait_type,
         CASE WHEN blocking_session_id = blocked AND wait_type LIKE 'LCK%' THEN res END AS block_text
  FROM raw),
waits AS (
  SELECT server_id, collection_time, waiting_task_address, wait_type, max(wait_duration_ms) AS wait_duration_ms, max(block_text) AS block_text
  FROM texts GROUP BY ALL),
profile AS (
  SELECT a.server_id, a.collection_time, a.session_id, a.request_id,
         CASE WHEN a.runnable_time IS NOT NULL THEN 'RUNNABLE' ELSE w.wait_type END AS wait_type,
         nullif(count(coalesce(a.runnable_time, w.wait_duration_ms)), 0) AS num_waits,
         min(coalesce(a.runnable_time, w.wait_duration_ms)) AS min_wait_ms,
         CAST(sum(coalesce(a.runnable_time, w.wait_duration_ms)) AS BIGINT) // nullif(count(coalesce(a.runnable_time, w.wait_duration_ms)), 0) AS avg_wait_ms,
         max(coalesce(a.runnable_time, w.wait_duration_ms)) AS max_wait_ms, max(w.block_text) AS block_text
  FROM active a LEFT JOIN waits w ON w.server_id = a.server_id AND w.collection_time = a.collection_time
   AND w.waiting_task_address = a.task_address AND w.wait_duration_ms > 0 AND a.runnable_time IS NULL
  GROUP BY ALL)
"""


def _active(v):
    # Both feed several joins with different columns, so each is written once.
    rows = cut_lineage(sessions.one_row_per_request(v("fx_procs")))
    return cut_lineage(waits.active_tasks(v("fx_tasks"), v("fx_workers"), v("fx_threads"), rows)), rows


def _profile(v):
    tasks, rows = _active(v)
    return waits.wait_profile(tasks, waits.session_waits(v("fx_waiting_tasks"), rows, v("fx_db_names")))


@query("distinct_waits", "WITH " + _WAITS_SQL + "SELECT * FROM waits")
def _(v):
    rows = sessions.one_row_per_request(v("fx_procs"))
    return waits.session_waits(v("fx_waiting_tasks"), rows, v("fx_db_names"))


@query("task_totals", "WITH " + _TASKS_SQL + """
SELECT server_id, collection_time, session_id, request_id, task_address,
       CAST(sum(pending_io_count) OVER w AS BIGINT) AS physical_io, CAST(sum(context_switches_count) OVER w AS BIGINT) AS context_switches,
       CAST(sum(thread_cpu_time) OVER w AS BIGINT) AS thread_cpu, count(*) OVER w AS tasks
FROM active WINDOW w AS (PARTITION BY server_id, collection_time, session_id, request_id)
""")
def _(v):
    return waits.task_totals(_active(v)[0]).select(*SK, "task_address", "physical_io", "context_switches", "thread_cpu", "tasks")


@query("wait_profile", "WITH " + _WAITS_SQL + """
SELECT p.*, CAST(t.physical_io AS BIGINT) AS physical_io, CAST(t.context_switches AS BIGINT) AS context_switches,
       CAST(t.thread_cpu AS BIGINT) AS thread_cpu, t.tasks
FROM profile p JOIN totals t USING (server_id, collection_time, session_id, request_id)
""")
def _(v):
    return _profile(v)


_RANK_SQL = _WAITS_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY server_id, collection_time, session_id, request_id
     ORDER BY block_text DESC NULLS LAST, num_waits DESC NULLS LAST, wait_type ASC NULLS FIRST) AS wait_rank FROM profile)
"""


@query("rank_waits", "WITH " + _RANK_SQL + "SELECT server_id, collection_time, session_id, request_id, wait_type, num_waits, wait_rank FROM ranked")
def _(v):
    return waits.rank_waits(_profile(v)).select(*SK, "wait_type", "num_waits", F.col("wait_rank").cast("bigint").alias("wait_rank"))


_SPREAD = """CASE WHEN num_waits = 1 OR min_wait_ms = max_wait_ms THEN CAST(max_wait_ms AS STRING)
     WHEN num_waits = 2 THEN CAST(min_wait_ms AS STRING) || '/' || CAST(max_wait_ms AS STRING)
     ELSE CAST(min_wait_ms AS STRING) || '/' || CAST(avg_wait_ms AS STRING) || '/' || CAST(max_wait_ms AS STRING) END"""


@query("task_summary", "WITH " + _RANK_SQL + f"""
SELECT r.server_id, r.collection_time, r.session_id, r.request_id, CAST(t.tasks AS BIGINT) AS tasks,
       max(CASE WHEN wait_rank = 1 THEN block_text END) AS block_text,
       coalesce(string_agg('(' || CAST(num_waits AS STRING) || 'x: ' || {_SPREAD} || 'ms)' || wait_type, ', ' ORDER BY wait_rank), '') AS wait_info
FROM ranked r JOIN totals t USING (server_id, collection_time, session_id, request_id)
GROUP BY r.server_id, r.collection_time, r.session_id, r.request_id, t.tasks
""")
def _(v):
    return waits.task_summary(waits.rank_waits(_profile(v))).select(*SK, "tasks", "block_text", "wait_info")


@query("wait_pages", "WITH " + _RANK_SQL + f"""
SELECT server_id, collection_time, session_id, request_id, CAST(floor((wait_rank - 1) / 2) AS BIGINT) AS page_no,
       string_agg('(' || CAST(num_waits AS STRING) || 'x: ' || {_SPREAD} || 'ms)' || wait_type, ', ' ORDER BY wait_rank) AS wait_info
FROM ranked WHERE wait_type IS NOT NULL GROUP BY ALL
""")
def _(v):
    return waits.wait_pages(waits.rank_waits(_profile(v)), page_rows=2).withColumn("page_no", F.col("page_no").cast("bigint"))


@query("blocked_object_names", "WITH " + _WAITS_SQL + """,
blocked AS (SELECT server_id, collection_time, session_id, request_id, max(block_text) AS block_text FROM profile GROUP BY ALL HAVING max(block_text) IS NOT NULL),
parsed AS (SELECT *, CAST(regexp_extract(block_text, 'hobtid=([0-9]+)', 1) AS BIGINT) AS hobt_id,
                  CAST(regexp_extract(block_text, 'dbid=([0-9]+)', 1) AS BIGINT) AS database_id FROM blocked)
SELECT p.server_id, p.collection_time, p.session_id, p.request_id, 'keylock' AS lock_type,
       'db' || CAST(p.database_id % 5 AS STRING) AS database_name, p.hobt_id, t.object_id AS target_object_id,
       s.name AS schema_name, o.name AS object_name
FROM parsed p
LEFT JOIN fx_partitions t ON t.server_id = p.server_id AND t.database_name = 'db' || CAST(p.database_id % 5 AS STRING) AND t.hobt_id = p.hobt_id
LEFT JOIN fx_objects o ON o.server_id = p.server_id AND o.database_name = 'db' || CAST(p.database_id % 5 AS STRING) AND o.object_id = t.object_id
LEFT JOIN fx_schemas s ON s.server_id = p.server_id AND s.database_name = 'db' || CAST(p.database_id % 5 AS STRING) AND s.schema_id = o.schema_id
""")
def _(v):
    profile = _profile(v)
    blocked = profile.groupBy(*SK).agg(F.max("block_text").alias("block_text")).filter("block_text is not null")
    databases = v("fx_procs").select(
        "server_id", "database_id", F.concat(F.lit("db"), (F.col("database_id") % 5).cast("string")).alias("name")
    ).distinct()
    return waits.blocked_object_names(blocked, databases, v("fx_partitions"), v("fx_objects"), v("fx_schemas"))


# ---- locks ---------------------------------------------------------------------------

_INVENTORY_SQL = """
parsed AS (
  SELECT server_id, collection_time, request_session_id AS session_id, request_request_id AS request_id,
         resource_type || CASE WHEN resource_subtype = '' THEN '' ELSE '.' || resource_subtype END AS resource_type, database_name,
         CASE WHEN resource_type = 'OBJECT' THEN resource_associated_entity_id
              ELSE TRY_CAST(nullif(regexp_extract(resource_description, 'object_id = ([0-9]+)', 1), '') AS BIGINT) END AS object_id,
         CASE WHEN resource_type = 'PAGE' THEN CAST(split_part(resource_description, ':', 1) AS BIGINT) END AS file_id,
         CASE WHEN resource_type = 'PAGE' THEN CAST(split_part(resource_description, ':', 2) AS BIGINT) END AS page_no,
         CASE WHEN resource_type IN ('PAGE', 'KEY') THEN resource_associated_entity_id END AS hobt_id,
         CASE WHEN resource_type = 'ALLOCATION_UNIT' THEN resource_associated_entity_id END AS allocation_unit_id,
         TRY_CAST(nullif(regexp_extract(resource_description, 'stats_id = ([0-9]+)', 1), '') AS BIGINT) AS index_id,
         CAST(NULL AS BIGINT) AS schema_id,
         TRY_CAST(nullif(regexp_extract(resource_description, 'principal_id = ([0-9]+)', 1), '') AS BIGINT) AS principal_id,
         request_mode, request_status, nullif(rtrim(resource_description), '') AS txt
  FROM fx_locks),
inventory AS (
  SELECT server_id, collection_time, session_id, request_id, resource_type, database_name, object_id, file_id,
         CASE WHEN page_no = 1 OR page_no % 8088 = 0 THEN 'PFS' WHEN page_no = 2 THEN 'GAM' WHEN page_no = 3 THEN 'SGAM'
              WHEN page_no = 6 THEN 'DCM' WHEN page_no = 7 THEN 'BCM' WHEN page_no IS NOT NULL THEN '*' END AS page_type,
         hobt_id, allocation_unit_id, index_id, schema_id, principal_id, request_mode, request_status,
         CASE WHEN coalesce(object_id, file_id, hobt_id, allocation_unit_id, index_id, principal_id) IS NULL THEN txt END AS resource_description,
         count(*) AS request_count
  FROM parsed GROUP BY ALL)
"""


@query("lock_inventory", "WITH " + _INVENTORY_SQL + "SELECT * FROM inventory")
def _(v):
    return locks.lock_inventory(v("fx_locks"))


@query("session_locks", "WITH " + _INVENTORY_SQL + """
SELECT i.*, s.start_time FROM inventory i JOIN fx_lock_sessions s USING (server_id, collection_time, session_id, request_id)
""")
def _(v):
    return locks.session_locks(v("fx_lock_sessions"), locks.lock_inventory(v("fx_locks")))


_NAMED_SQL = _INVENTORY_SQL + """,
keyed AS (
  SELECT i.*, CASE WHEN a.type IN (1, 3) THEN a.container_id END AS in_row, CASE WHEN i.hobt_id IS NULL AND a.type = 2 THEN a.container_id END AS lob
  FROM inventory i LEFT JOIN fx_alloc_units a USING (server_id, database_name, allocation_unit_id)),
named AS (
  SELECT k.* EXCLUDE (in_row, lob), o.name AS object_name, x.name AS index_name, s.name AS schema_name, d.name AS principal_name
  FROM keyed k
  LEFT JOIN fx_partitions p ON p.server_id = k.server_id AND p.database_name = k.database_name AND p.hobt_id = coalesce(k.hobt_id, k.in_row)
  LEFT JOIN fx_partitions q ON q.server_id = k.server_id AND q.database_name = k.database_name AND q.partition_id = k.lob
  LEFT JOIN fx_objects o ON o.server_id = k.server_id AND o.database_name = k.database_name AND o.object_id = coalesce(k.object_id, p.object_id, q.object_id)
  LEFT JOIN fx_catalog_indexes x ON x.server_id = k.server_id AND x.database_name = k.database_name
   AND x.object_id = coalesce(k.object_id, p.object_id, q.object_id) AND x.index_id = coalesce(k.index_id, p.index_id, q.index_id)
  LEFT JOIN fx_schemas s ON s.server_id = k.server_id AND s.database_name = k.database_name AND s.schema_id = coalesce(k.schema_id, o.schema_id)
  LEFT JOIN fx_principals d ON d.server_id = k.server_id AND d.database_name = k.database_name AND d.principal_id = k.principal_id)
"""


def _named(v):
    return locks.resolve_object_names(
        locks.lock_inventory(v("fx_locks")), v("fx_alloc_units"), v("fx_partitions"), v("fx_objects"),
        v("fx_catalog_indexes"), v("fx_schemas"), v("fx_principals"),
    )


@query("resolve_object_names", "WITH " + _NAMED_SQL + "SELECT * FROM named")
def _(v):
    return _named(v)


@query("lock_document", "WITH " + _NAMED_SQL + """,
leaf AS (
  SELECT server_id, collection_time, session_id, request_id, database_name, resource_type = 'DATABASE' AS on_db,
         CASE WHEN resource_type <> 'DATABASE' THEN coalesce(object_name, '(null)') END AS object_label,
         CASE WHEN resource_type <> 'DATABASE' THEN schema_name END AS object_schema,
         CASE WHEN resource_type <> 'DATABASE' THEN resource_type END AS rt, CASE WHEN resource_type <> 'DATABASE' THEN page_type END AS pt,
         CASE WHEN resource_type <> 'DATABASE' THEN index_name END AS ix,
         CASE WHEN resource_type <> 'DATABASE' AND object_name IS NULL THEN schema_name END AS sn,
         CASE WHEN resource_type <> 'DATABASE' THEN principal_name END AS pn, CASE WHEN resource_type <> 'DATABASE' THEN resource_description END AS rd,
         request_mode, request_status, sum(CASE WHEN resource_type = 'DATABASE' THEN 1 ELSE request_count END) AS n
  FROM named GROUP BY ALL),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY server_id, collection_time, session_id, request_id
     ORDER BY database_name NULLS FIRST, on_db, object_label NULLS FIRST, object_schema NULLS FIRST, rt NULLS FIRST, pt NULLS FIRST,
              ix NULLS FIRST, sn NULLS FIRST, pn NULLS FIRST, rd NULLS FIRST, request_mode, request_status) - 1) // 1000 AS page_no FROM leaf),
lock_text AS (
  SELECT *, '<Lock' || coalesce(' resource_type="' || rt || '"', '') || coalesce(' page_type="' || pt || '"', '') || coalesce(' index_name="' || ix || '"', '')
     || coalesce(' schema_name="' || sn || '"', '') || coalesce(' principal_name="' || pn || '"', '') || coalesce(' resource_description="' || rd || '"', '')
     || ' request_mode="' || request_mode || '" request_status="' || request_status || '" request_count="' || CAST(n AS STRING) || '"/>' AS t FROM numbered),
object_text AS (
  SELECT server_id, collection_time, session_id, request_id, page_no, database_name, on_db, object_label, object_schema,
         string_agg(t, '' ORDER BY rt NULLS FIRST, pt NULLS FIRST, ix NULLS FIRST, sn NULLS FIRST, pn NULLS FIRST, rd NULLS FIRST, request_mode, request_status) AS t
  FROM lock_text GROUP BY ALL),
database_text AS (
  SELECT server_id, collection_time, session_id, request_id, page_no, database_name,
         '<Database name="' || database_name || '">' || coalesce('<Locks>' || string_agg(t, '') FILTER (on_db) || '</Locks>', '')
         || coalesce('<Objects>' || string_agg('<Object name="' || object_label || '"' || coalesce(' schema_name="' || object_schema || '"', '') || '><Locks>' || t || '</Locks></Object>', ''
              ORDER BY object_label, object_schema NULLS FIRST) FILTER (NOT on_db) || '</Objects>', '') || '</Database>' AS t
  FROM object_text GROUP BY server_id, collection_time, session_id, request_id, page_no, database_name)
SELECT server_id, collection_time, session_id, request_id, CAST(page_no AS BIGINT) AS page_no, string_agg(t, '' ORDER BY database_name) AS locks
FROM database_text GROUP BY ALL
""")
def _(v):
    documents = locks.lock_document(_named(v))
    return locks.lock_document_text(documents).withColumn("page_no", F.col("page_no").cast("bigint"))


# ---- deltas and usage ----------------------------------------------------------------

_PAIRS_SQL = """
times AS (SELECT server_id, collection_time, lag(collection_time) OVER (PARTITION BY server_id ORDER BY collection_time) AS previous_time
          FROM (SELECT DISTINCT server_id, collection_time FROM fx_snapshots)),
pairs AS (
  SELECT c.*, p.session_id IS NOT NULL AND p.last_request_start_time = c.last_request_start_time AS ok,
         c.physical_io - p.physical_io AS d1, c.reads - p.reads AS d2, c.physical_reads - p.physical_reads AS d3, c.writes - p.writes AS d4,
         c.tempdb_allocations - p.tempdb_allocations AS d5, c.tempdb_current - p.tempdb_current AS d6, c.context_switches - p.context_switches AS d7,
         c.used_memory - p.used_memory AS d8, c.max_used_memory - p.max_used_memory AS d9, c.cpu - p.cpu AS dc, c.thread_cpu - p.thread_cpu AS dt
  FROM fx_snapshots c JOIN times t USING (server_id, collection_time)
  LEFT JOIN fx_snapshots p ON p.server_id = c.server_id AND p.session_id = c.session_id AND p.request_id = c.request_id AND p.collection_time = t.previous_time)
"""
DELTA_SQL = "WITH " + _PAIRS_SQL + "SELECT server_id, collection_time, session_id, request_id, " + ", ".join(
    f"CASE WHEN ok AND d{i} >= 0 THEN d{i} END AS {m}_delta" for i, m in enumerate(deltas.METRICS, start=1)
)
_CPU_SQL = "CASE WHEN ok THEN CASE WHEN dt > dc AND dt > 0 THEN dt WHEN dc >= 0 THEN dc END END AS cpu_delta"


@query("session_deltas", DELTA_SQL + f", {_CPU_SQL} FROM pairs")
def _(v):
    out = deltas.session_deltas(v("fx_snapshots"))
    return out.select(*SK, *[f"{m}_delta" for m in deltas.METRICS], "cpu_delta")


@query("cpu_delta", "WITH " + _PAIRS_SQL + f"SELECT server_id, collection_time, session_id, request_id, {_CPU_SQL} FROM pairs")
def _(v):
    return deltas.cpu_delta(v("fx_snapshots")).select(*SK, "cpu_delta")


@query("num_events", """
SELECT server_id, collection_time, session_id, request_id, count(*) OVER (PARTITION BY server_id, collection_time, session_id, request_id) AS num_events
FROM fx_procs
""")
def _(v):
    procs = v("fx_procs").select(*SK)
    return ranking.null_safe_join(procs, deltas.num_events(procs), SK, "left")


@query("tempdb_usage", """
WITH pages AS (
  SELECT server_id, collection_time, session_id, request_id,
         user_objects_alloc_page_count + internal_objects_alloc_page_count AS a,
         user_objects_dealloc_page_count + internal_objects_dealloc_page_count AS d FROM fx_task_space
  UNION ALL
  SELECT server_id, collection_time, session_id, -1, user_objects_alloc_page_count + internal_objects_alloc_page_count,
         user_objects_dealloc_page_count + internal_objects_dealloc_page_count FROM fx_session_space)
SELECT server_id, collection_time, session_id, CAST(request_id AS BIGINT) AS request_id, CAST(sum(a) AS BIGINT) AS tempdb_allocations,
       CAST(greatest(sum(a) - sum(d), 0) AS BIGINT) AS tempdb_current
FROM pages JOIN fx_lock_sessions s USING (server_id, collection_time, session_id) GROUP BY ALL
""".replace("SELECT server_id, collection_time, session_id, CAST(request_id", "SELECT server_id, collection_time, session_id, CAST(pages.request_id"))
def _(v):
    return usage.tempdb_usage(v("fx_task_space"), v("fx_session_space"), v("fx_lock_sessions"))


_TX_SQL = """
owned AS (
  SELECT d.*, a.name, t.session_id AS bound_session FROM fx_db_tx d
  JOIN fx_active_tx a ON a.server_id = d.server_id AND a.transaction_id = d.transaction_id AND a.transaction_begin_time <= a.collection_time
  LEFT JOIN fx_session_tx t ON t.server_id = d.server_id AND t.transaction_id = d.transaction_id
  WHERE d.database_id < 32767),
owners AS (
  SELECT o.server_id, o.transaction_id, o.database_id, s.session_id, s.request_id,
         row_number() OVER (PARTITION BY o.server_id, o.transaction_id, o.database_id ORDER BY s.request_id, s.session_id) AS r
  FROM owned o JOIN fx_tx_sessions s ON s.server_id = o.server_id AND (s.transaction_id = o.transaction_id OR s.session_id = o.bound_session)),
log_usage AS (
  SELECT o.server_id, o.collection_time, w.session_id, w.request_id, o.database_id, CAST(sum(o.log_record_count) AS BIGINT) AS log_record_count,
         CAST(sum(o.log_bytes_used) AS BIGINT) // 1024 AS log_kb_used, min(o.begin_time) AS transaction_start_time,
         bool_or(o.name = 'implicit_transaction') AS implicit_tran
  FROM owned o JOIN owners w ON w.r = 1 AND w.server_id = o.server_id AND w.transaction_id = o.transaction_id AND w.database_id = o.database_id
  GROUP BY ALL),
tx_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY server_id, collection_time, session_id, request_id ORDER BY transaction_start_time DESC, database_id) AS tran_rank
  FROM log_usage)
"""


def _log_usage(v):
    return usage.transaction_log_usage(v("fx_active_tx"), v("fx_db_tx"), v("fx_session_tx"), v("fx_tx_sessions"))


@query("transaction_log_usage", "WITH " + _TX_SQL + "SELECT * FROM log_usage")
def _(v):
    return _log_usage(v)


@query("rank_transactions", "WITH " + _TX_SQL + "SELECT server_id, collection_time, session_id, request_id, database_id, transaction_start_time, tran_rank FROM tx_ranked")
def _(v):
    return usage.rank_transactions(_log_usage(v)).select(
        *SK, "database_id", "transaction_start_time", F.col("tran_rank").cast("bigint").alias("tran_rank")
    )


@query("transaction_text", "WITH " + _TX_SQL + """
SELECT server_id, collection_time, session_id, request_id, max(CASE WHEN tran_rank = 1 THEN transaction_start_time END) AS tran_start_time,
       string_agg('db' || CAST(database_id AS STRING) || ': ' || CAST(log_record_count AS STRING) || ' (' || CAST(log_kb_used AS STRING) || ' kB),', '' ORDER BY tran_rank) AS tran_log_writes,
       bool_or(CASE WHEN tran_rank = 1 THEN implicit_tran END) AS implicit_tran
FROM tx_ranked GROUP BY ALL
""")
def _(v):
    ranked = usage.rank_transactions(_log_usage(v)).withColumn("database_name", F.concat(F.lit("db"), F.col("database_id").cast("string")))
    return usage.transaction_text(ranked)


# ---- statement text and times --------------------------------------------------------

_OFFSETS = """
offs AS (SELECT doc_id, text, (doc_id % 50) * 2 AS b, CASE WHEN lang = 'en' THEN -1 ELSE (doc_id % 50) * 2 + 200 END AS e FROM documents)
"""


@query("active_statement", "WITH " + _OFFSETS + """,
cut AS (
  SELECT doc_id, regexp_replace(CASE
      WHEN length(rtrim(text, ' ')) < e // 2 + 1 OR (b // 2 > 0 AND regexp_matches(substr(text, b // 2, 2), '^[a-zA-Z0-9][a-zA-Z0-9]$')) THEN text
      WHEN b > 0 THEN substr(text, b // 2 + 1, CASE WHEN e = -1 THEN length(text) ELSE (e - b) // 2 + 1 END)
      ELSE trim(text, ' ') END, '[\x01-\x08\x0b\x0c\x0e-\x1f]', '?', 'g') AS t FROM offs)
SELECT doc_id, length(t) AS characters, md5(t) AS digest FROM cut
""")
def _(v):
    start = (F.col("doc_id") % 50) * 2
    end = F.when(F.col("lang") == "en", F.lit(-1).cast("bigint")).otherwise(start + 200)
    rows = v("documents").select("doc_id", active_statement(F.col("text"), start, end).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("characters"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("request_start_time", """
WITH shaped AS (
  SELECT event_id, user_id % 3 <> 0 AS is_user, event_id % 100000 AS elapsed, CAST(ts AS TIMESTAMP) AS now,
         CASE WHEN event_type = 'click' THEN NULL ELSE CAST(ts AS TIMESTAMP) - INTERVAL '1' HOUR END AS request,
         CASE WHEN event_type = 'view' THEN TIMESTAMP '1900-01-01 00:00:00' ELSE CAST(ts AS TIMESTAMP) - INTERVAL '2' HOUR END AS batch FROM events),
derived AS (SELECT *, epoch_us(now) // 1000 - elapsed // 1000 * 1000 AS m FROM shaped),
rounded AS (SELECT *, m - m % 1000 + (m % 1000) // 500 * 1000 AS r FROM derived)
SELECT event_id, CASE WHEN NOT is_user THEN CAST(make_timestamp(r * 1000) AS TIMESTAMP)
       ELSE coalesce(nullif(coalesce(request, batch), TIMESTAMP '1900-01-01 00:00:00'), now - INTERVAL '3' HOUR) END AS start_time,
       CASE WHEN is_user THEN request ELSE CAST(make_timestamp(r * 1000) AS TIMESTAMP) END AS last_request_start_time
FROM rounded
""")
def _(v):
    now = F.col("ts").cast("timestamp")
    hours = lambda n: now - F.expr(f"interval {n} hours")
    is_user, elapsed = F.col("user_id") % 3 != 0, F.col("event_id") % 100000
    request = F.when(F.col("event_type") != "click", hours(1))
    batch = F.when(F.col("event_type") == "view", F.lit("1900-01-01 00:00:00").cast("timestamp")).otherwise(hours(2))
    return v("events").select(
        "event_id", request_start_time(is_user, elapsed, request, batch, hours(3), now).alias("start_time"),
        last_request_start(is_user, elapsed, request, now).alias("last_request_start_time"),
    )


# ---- the whole monitor ---------------------------------------------------------------

_MONITOR_NAMES = {
    "procs": "fx_procs", "sessions": "fx_live_sessions", "requests": "fx_requests", "databases": "fx_db_names",
    "tasks": "fx_tasks", "workers": "fx_workers", "threads": "fx_threads", "waiting_tasks": "fx_waiting_tasks",
    "query_stats": "fx_query_stats",
}


def _monitor_inputs(v):
    return {name: v(view) for name, view in _MONITOR_NAMES.items()}


_MONITOR_SQL = _REQUEST_SQL.replace("joined AS (", "joined0 AS (") + """,
joined AS (SELECT j.*, d.name AS database_name, nullif(j.blocked, 0) AS blocking_session_id
           FROM joined0 j LEFT JOIN fx_db_names d ON d.server_id = j.server_id AND d.collection_time = j.collection_time AND d.database_id = j.database_id),
kept AS (SELECT server_id, collection_time, session_id, blocking_session_id FROM joined
         WHERE (status <> 'sleeping' OR open_tran_count > 0) AND host_process <> '' AND lower(login_name) LIKE 'user1%'),
walk AS (
  SELECT * FROM kept
  UNION
  SELECT j.server_id, j.collection_time, j.session_id, j.blocking_session_id
  FROM walk w JOIN joined j ON j.server_id = w.server_id AND j.collection_time = w.collection_time AND j.session_id = w.blocking_session_id),
found AS (SELECT DISTINCT server_id, collection_time, session_id FROM walk),
kept_sessions AS (SELECT DISTINCT server_id, collection_time, session_id FROM kept),
chosen AS (
  SELECT j.*, k.session_id IS NULL AS is_added FROM joined j JOIN found f USING (server_id, collection_time, session_id)
  LEFT JOIN kept_sessions k USING (server_id, collection_time, session_id)
  WHERE k.session_id IS NULL OR ((j.status <> 'sleeping' OR j.open_tran_count > 0) AND j.host_process <> '' AND lower(j.login_name) LIKE 'user1%'))
"""


@query("session_snapshot", "WITH RECURSIVE " + _MONITOR_SQL + """
SELECT c.server_id, c.collection_time, c.session_id, c.request_id, c.is_added, c.status, c.login_name, c.database_name, c.reads, c.writes, c.cpu_time,
       c.blocking_session_id, CASE WHEN c.wait_type IS NOT NULL THEN '(' || CAST(c.wait_time AS STRING) || 'ms)' || c.wait_type || CASE
         WHEN c.wait_type LIKE 'PAGE%LATCH%' THEN ':' || coalesce(c.database_name, '(null)') || ':' || split_part(c.wait_resource, ':', 2)
              || CASE WHEN split_part(c.wait_resource, ':', 3) = '1' OR CAST(split_part(c.wait_resource, ':', 3) AS BIGINT) % 8088 = 0 THEN '(PFS)' ELSE '(*)' END
         WHEN c.wait_type LIKE 'LATCH%' THEN ' [' || c.wait_resource || ']' ELSE '' END END AS wait_info,
       (q.total_elapsed_time // q.execution_count) // 1000 AS avg_elapsed_ms
FROM chosen c LEFT JOIN fx_query_stats q ON q.server_id = c.server_id AND q.sql_handle = c.active_sql_handle
 AND q.plan_handle = c.plan_handle AND q.stmt_start = c.active_stmt_start AND q.stmt_end = c.active_stmt_end
""")
def _(v):
    report = session_monitor.session_snapshot(_monitor_inputs(v), ("average",), include=("login", "user1%"))
    return report.select(
        *SK, "is_added", "status", "login_name", "database_name", "reads", "writes", "cpu_time", "blocking_session_id", "wait_info", "avg_elapsed_ms"
    )


_FULL_SQL = _RANK_SQL + f""",
members AS (SELECT DISTINCT server_id, collection_time, session_id FROM picked),
edges AS (
  SELECT DISTINCT p.server_id, p.collection_time, p.session_id, p.blocked AS blocker FROM picked p
  JOIN members m ON m.server_id = p.server_id AND m.collection_time = p.collection_time AND m.session_id = p.blocked
  WHERE p.blocked <> 0 AND p.blocked <> p.session_id),
down AS (
  SELECT server_id, collection_time, session_id AS top, session_id AS here, [session_id] AS path FROM members
  UNION ALL
  SELECT d.server_id, d.collection_time, d.top, e.session_id, list_append(d.path, e.session_id)
  FROM down d JOIN edges e ON e.server_id = d.server_id AND e.collection_time = d.collection_time AND e.blocker = d.here
  WHERE NOT list_contains(d.path, e.session_id)),
blocked_counts AS (SELECT server_id, collection_time, top AS session_id, count(*) - 1 AS blocked_session_count FROM down GROUP BY ALL),
up AS (
  SELECT server_id, collection_time, session_id, session_id AS here, 0 AS hops, [session_id] AS path FROM members
  UNION ALL
  SELECT u.server_id, u.collection_time, u.session_id, e.blocker, u.hops + 1, list_append(u.path, e.blocker)
  FROM up u JOIN edges e ON e.server_id = u.server_id AND e.collection_time = u.collection_time AND e.session_id = u.here
  WHERE NOT list_contains(u.path, e.blocker)),
tops AS (
  SELECT server_id, collection_time, session_id, min(hops) AS depth, arg_min(here, (hops, here)) AS root_session_id FROM up
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.server_id = up.server_id AND e.collection_time = up.collection_time AND e.session_id = up.here) GROUP BY ALL),
summary AS (
  SELECT r.server_id, r.collection_time, r.session_id, r.request_id, CAST(t.tasks AS BIGINT) AS tasks, CAST(t.physical_io AS BIGINT) AS physical_io,
         string_agg('(' || CAST(num_waits AS STRING) || 'x: ' || {_SPREAD} || 'ms)' || wait_type, ', ' ORDER BY wait_rank) AS waits
  FROM ranked r JOIN totals t USING (server_id, collection_time, session_id, request_id)
  GROUP BY r.server_id, r.collection_time, r.session_id, r.request_id, t.tasks, t.physical_io)
"""


@query("session_snapshot_full", "WITH RECURSIVE " + _FULL_SQL + """
SELECT p.server_id, p.collection_time, p.session_id, p.request_id, p.status, s.tasks, s.physical_io, s.waits AS task_waits,
       CAST(b.blocked_session_count AS BIGINT) AS blocked_session_count, CAST(t.depth AS BIGINT) AS depth, t.root_session_id
FROM picked p JOIN blocked_counts b USING (server_id, collection_time, session_id)
LEFT JOIN tops t ON t.server_id = p.server_id AND t.collection_time = p.collection_time AND t.session_id = p.session_id
LEFT JOIN summary s ON s.server_id = p.server_id AND s.collection_time = p.collection_time AND s.session_id = p.session_id AND s.request_id = p.request_id
""")
def _(v):
    report = session_monitor.session_snapshot(_monitor_inputs(v), ("tasks", "average", "blocking"), sleeping=2, system=True)
    # Requests without task waits fall back to their own wait; only the former are compared.
    task_waits = F.when(F.col("wait_info").rlike(r"^\(\d+x: "), F.col("wait_info"))
    return report.select(
        *SK, "status", "tasks", "physical_io", task_waits.alias("task_waits"), "blocked_session_count", "depth", "root_session_id"
    )


@query("agent_job_names", """
SELECT l_partkey % 8 AS server_id, l_orderkey AS session_id, l_linenumber AS step_id, CASE WHEN p.p_brand <> 'Brand#13' THEN p.p_name || CAST(p.p_partkey AS STRING) END AS job_name,
       CASE WHEN p.p_brand <> 'Brand#13' THEN 'Step ' || CAST(l_linenumber AS STRING) END AS step_name
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
""")
def _(v):
    # Job ids as the engine writes them: the first eight bytes of the id are stored byte-reversed by group.
    digits = F.lpad(F.hex("l_partkey"), 32, "0")
    part = lambda start, length: F.substring(digits, start, length)
    guid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    program = F.concat(F.lit("SQLAgent - TSQL JobStep (Job 0x"), digits, F.lit(" : Step "), F.col("l_linenumber").cast("string"), F.lit(")"))
    rows = v("lineitem").select((F.col("l_partkey") % 8).alias("server_id"), F.col("l_orderkey").alias("session_id"), program.alias("program_name"))
    jobs = v("part").select(
        (F.col("p_partkey") % 8).alias("server_id"), F.expr("CASE WHEN p_brand <> 'Brand#13' THEN p_partkey ELSE p_partkey + 1000000000 END").alias("l_partkey"),
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"),
    ).withColumn("job_id", guid).drop("l_partkey")
    steps = v("lineitem").select((F.col("l_partkey") % 8).alias("server_id"), guid.alias("job_id"), F.col("l_linenumber").alias("step_id")).distinct()
    steps = steps.withColumn("step_name", F.concat(F.lit("Step "), F.col("step_id").cast("string")))
    named = usage.agent_job_names(rows, jobs, steps)
    return named.select("server_id", "session_id", F.col("step_id").cast("int").alias("step_id"), "job_name", "step_name")


_SWITCHES = sessions.SWITCHES


@query("monitor_memory_and_options", "WITH " + _RANK_SQL + """
SELECT p.server_id, p.collection_time, p.session_id, p.request_id, m.requested_memory_kb // 8 AS requested_memory, m.granted_memory_kb // 8 AS granted_memory,
       m.max_used_memory_kb // 8 AS max_used_memory, o.text_size, o.language, o.lock_timeout, """ + ", ".join(
    f"CASE o.{c} WHEN 1 THEN 'ON' WHEN 0 THEN 'OFF' END AS {c}" for c in _SWITCHES
) + """,
       CASE o.transaction_isolation_level WHEN 0 THEN 'Unspecified' WHEN 1 THEN 'ReadUncomitted' WHEN 2 THEN 'ReadCommitted' WHEN 3 THEN 'Repeatable'
            WHEN 4 THEN 'Serializable' WHEN 5 THEN 'Snapshot' END AS isolation_level
FROM picked p LEFT JOIN fx_memory_grants m USING (server_id, collection_time, session_id, request_id)
LEFT JOIN fx_session_options o USING (server_id, collection_time, session_id)
""")
def _(v):
    inputs = {**_monitor_inputs(v), "memory_grants": v("fx_memory_grants"), "session_options": v("fx_session_options")}
    report = session_monitor.session_snapshot(inputs, ("memory", "options"), sleeping=2, system=True)
    told = ["text_size", "language", "lock_timeout", *_SWITCHES]
    return report.select(
        *SK, "requested_memory", "granted_memory", "max_used_memory", *[F.col(f"additional_info.{c}").alias(c) for c in told],
        F.col("additional_info.transaction_isolation_level").alias("isolation_level"),
    )


@query("monitor_blocked_objects", "WITH " + _RANK_SQL + """,
first_waits AS (SELECT server_id, collection_time, session_id, request_id, max(CASE WHEN wait_rank = 1 THEN block_text END) AS block_text FROM ranked GROUP BY ALL),
blocks AS (SELECT *, CAST(regexp_extract(block_text, 'hobtid=([0-9]+)', 1) AS BIGINT) AS hobt_id,
                  CAST(regexp_extract(block_text, 'dbid=([0-9]+)', 1) AS BIGINT) AS database_id FROM first_waits WHERE block_text IS NOT NULL)
SELECT p.server_id, p.collection_time, p.session_id, p.request_id, d.name AS blocked_database, t.hobt_id AS blocked_hobt, s.name AS blocked_schema, o.name AS blocked_name
FROM picked p
LEFT JOIN blocks t USING (server_id, collection_time, session_id, request_id)
LEFT JOIN (SELECT DISTINCT server_id, database_id, name FROM fx_db_names) d ON d.server_id = t.server_id AND d.database_id = t.database_id
LEFT JOIN fx_partitions q ON q.server_id = t.server_id AND q.database_name = d.name AND q.hobt_id = t.hobt_id
LEFT JOIN fx_objects o ON o.server_id = t.server_id AND o.database_name = d.name AND o.object_id = q.object_id
LEFT JOIN fx_schemas s ON s.server_id = t.server_id AND s.database_name = d.name AND s.schema_id = o.schema_id
""")
def _(v):
    inputs = {**_monitor_inputs(v), "partitions": v("fx_partitions"), "objects": v("fx_objects"), "schemas": v("fx_schemas")}
    report = session_monitor.session_snapshot(inputs, ("tasks", "blocked_objects"), sleeping=2, system=True)
    at = F.col("blocked_object")
    return report.select(
        *SK, at["database_name"].alias("blocked_database"), at["hobt_id"].alias("blocked_hobt"), at["schema_name"].alias("blocked_schema"),
        at["object_name"].alias("blocked_name"),
    )


@query("order_output", """
WITH reported AS (
  SELECT server_id, collection_time, session_id, request_id, max(last_batch) AS start_time FROM fx_procs GROUP BY ALL)
SELECT * FROM reported ORDER BY start_time DESC, server_id, collection_time, session_id, request_id LIMIT 50
""")
def _(v):
    reported = v("fx_procs").groupBy(*SK).agg(F.max("last_batch").alias("start_time"))
    return session_monitor.order_output(reported, "-start_time").limit(50)
