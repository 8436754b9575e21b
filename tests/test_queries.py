import re

import duckdb
import pytest

from harness import QUERIES
from __spark_entry__ import entry, oracle_sql, queries
from harness.core import TABLES
from tools.compare import rows_of

SMALL = "/root/testdata/sf0.001"

# One or two per area; tools/compare.py runs them all.
SAMPLE = [
    "blocking_chains_rings", "blocker_closure", "primary_wait", "session_request_join", "task_summary", "lock_inventory", "lock_document",
    "session_deltas", "transaction_text", "cpu_history", "replace_today", "job_definition_drift", "unsynced_databases", "tempdb_tracking",
    "report_document", "alert_events_storm", "outbox_pending", "resolve_selection", "backup_files", "integrity_plan", "index_plan", "partition_counts",
    "session_snapshot", "stream_drift",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, duck, name):
    df = queries()[name](spark, SMALL)
    cursor = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["server_id", "collection_time", "session_id", "blocked_session_count", "depth", "root_session_id"]
    assert df.first().blocked_session_count > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Streams and table writers run on the JVM as well; they are built above and by compare.py.
PLANNED = [n for n in QUERIES if not n.startswith(("stream_", "append_", "replace_", "purge_days", "read_"))]


@pytest.mark.parametrize("chunk", range(6))
def test_plans_have_no_product_python_or_single_task_window(spark, chunk):
    for name in PLANNED[chunk::6]:
        plan = plan_of(queries()[name](spark, SMALL))
        assert not re.search(r"CartesianProduct|NestedLoop|Python|ArrowEval|CollectLimit", plan), name
        assert not re.search(r"Window.*\n(?:.*(?:Sort|Project|AQEShuffleRead|ShuffleQueryStage).*\n)*.*SinglePartition", plan), name


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(queries()["filter_sessions"](spark, SMALL))
    scan = re.search(r"ReadSchema: (struct<[^\n]*>)", plan).group(1)
    assert scan == "struct<event_id:bigint,user_id:bigint>", "columns of no use are not read"
    plan = plan_of(queries()["read_telemetry"](spark, SMALL))
    assert re.search(r"PartitionFilters: \[[^\]]*collection_date", plan) and "In(server_id, [1,5])" in plan
