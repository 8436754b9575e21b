import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import backup_rules, checks, index_rules, jobs, ranking, selection
from fleetscope.plans import maintenance
from fleetscope.runtime import freeze_dealt
from fleetscope.sources.selectors import expand_selectors

NOW = dt.datetime(2024, 1, 31)


# ---- selection -----------------------------------------------------------------------

NAMES = "server_id int, name string, is_distributor boolean, source_database_id int, in_group boolean"


def pick(frame, rows, spec, *names):
    df = selection.database_names(frame(NAMES, [(1, n, False, None, n.startswith("ag")) for n in names]))
    out = selection.resolve_selection(df, frame("server_id int, policy_id int, spec string", [(1, 1, spec)]))
    return {n: p for n, s, p in rows(out, "name", "selected", "start_position") if s}


def test_excludes_win_and_positions_come_from_includes(frame, rows):
    assert pick(frame, rows, "-a%, b, USER_DATABASES", "a1", "b", "c", "master") == {"b": 2, "c": 3}
    assert pick(frame, rows, "a%,-a%", "a1") == {}
    assert pick(frame, rows, "x_y", "xzy", "x_y") == {"x_y": 1}
    assert pick(frame, rows, "[we%ird],[a.b]", "a.b", "we1ird") == {"we1ird": 1, "a.b": 2}
    assert pick(frame, rows, "system_databases", "master", "MSDB", "u") == {"master": 1, "MSDB": 1}
    assert pick(frame, rows, "AVAILABILITY_GROUP_DATABASES", "ag1", "u") == {"ag1": 1}
    assert pick(frame, rows, None, "u", "tempdb") == {"u": None}


@pytest.mark.parametrize("spec", ["%a%,-b%,ab", "b,-%,a%", "-x,%", "a\n, b ,\r-ab"])
def test_selection_property(frame, rows, spec):
    names = ["a", "ab", "ba", "b", "x", "xa"]
    items = [i.strip() for i in spec.replace("\n", "").replace("\r", "").split(",")]

    def like(name, pattern):
        import fnmatch
        return fnmatch.fnmatchcase(name, pattern.replace("%", "*"))

    want = {}
    for n in names:
        hits = [i + 1 for i, item in enumerate(items) if not item.startswith("-") and like(n, item)]
        if hits and not any(item.startswith("-") and like(n, item[1:]) for item in items):
            want[n] = hits[0]
    assert pick(frame, rows, spec, *names) == want


def test_dotted_selectors(frame, rows):
    policies = frame("policy_id int, spec string", [(1, "d.s.o, d.s.o.i,ALL_INDEXES,-[d.1].s.[o x]")])
    got = rows(expand_selectors(policies, "indexes"), "position", "selected", "database_name", "schema_name", "object_name", "index_name")
    assert got == [
        (1, True, "d", "s", "o", "%"), (2, True, "d", "s", "o", "i"), (3, True, "%", "%", "%", "%"), (4, False, "d.1", "s", "o x", "%"),
    ]
    objects = expand_selectors(frame("policy_id int, spec string", [(1, "ALL_OBJECTS,d.s.o"), (2, None)]), "objects")
    assert rows(objects, "position", "database_name", "object_name") == [(1, "%", "%"), (2, "d", "o")]
    groups = expand_selectors(frame("policy_id int, spec string", [(1, "ALL_FILEGROUPS,-d.f")]), "filegroups")
    assert rows(groups, "selected", "database_name", "filegroup_name") == [(False, "d", "f"), (True, "%", "%")]


def test_ambiguous_names_need_a_selected_one(frame, rows):
    df = frame("server_id int, policy_id int, file_system_name string, selected boolean", [
        (1, 1, "ab", True), (1, 1, "AB", False), (1, 1, "c", False), (1, 1, "C", False), (1, 1, "", True), (1, 1, "", True),
    ])
    assert rows(selection.ambiguous_names(df), "file_system_name") == [("AB",), ("ab",)]


# ---- backup --------------------------------------------------------------------------

DB = (
    "server_id int, name string, state string, user_access string, is_accessible boolean, in_standby boolean, recovery_model string, "
    "is_read_only boolean, log_lsn bigint, differential_base_lsn bigint, differential_base_is_snapshot boolean, allocated_pages bigint, "
    "modified_pages bigint, database_pages bigint, log_size_mb double, last_log_backup timestamp, availability_group string, "
    "replica_role string, is_preferred_replica boolean, log_shipping_role string"
)
BASE = dict(
    server_id=1, name="db", state="ONLINE", user_access="MULTI_USER", is_accessible=True, in_standby=False, recovery_model="FULL",
    is_read_only=False, log_lsn=5, differential_base_lsn=4, differential_base_is_snapshot=False, allocated_pages=1000, modified_pages=100,
    database_pages=2000, log_size_mb=10.0, last_log_backup=dt.datetime(2024, 1, 30), availability_group=None, replica_role=None,
    is_preferred_replica=None, log_shipping_role=None,
)


@pytest.fixture
def decide(frame):
    def run(policy, **changes):
        row = {**BASE, **changes}
        df = frame(DB, [tuple(row.values())])
        defaults = {n: F.lit(policy.get(n, v)).cast(k) for n, (k, v) in backup_rules.POLICY_DEFAULTS.items()}
        df = backup_rules.backup_type_decision(df.withColumns(defaults))
        return backup_rules.backup_file_count(backup_rules.backup_eligibility(df, NOW))
    return run


def test_escalation_order(decide):
    kind = lambda policy, **c: decide({"change_backup_type": True, **policy}, **c).first().decided_backup_type
    assert kind({"backup_type": "LOG"}) == "LOG"
    assert kind({"backup_type": "LOG"}, log_lsn=None) == "DIFF"
    assert kind({"backup_type": "LOG"}, log_lsn=None, differential_base_lsn=None) == "FULL"
    assert kind({"backup_type": "LOG"}, log_lsn=None, name="master") == "LOG"
    assert kind({"backup_type": "DIFF"}, name="master") == "FULL"
    assert kind({"backup_type": "DIFF", "modification_level": 10}) == "FULL"
    assert kind({"backup_type": "DIFF", "modification_level": 11}) == "DIFF"
    assert kind({"backup_type": "DIFF", "modification_level": 10}, allocated_pages=0) == "DIFF"
    assert kind({"backup_type": "DIFF"}, differential_base_is_snapshot=True) == "FULL"
    assert kind({"backup_type": "LOG", "change_backup_type": False}, log_lsn=None) == "LOG"


def test_reasons_and_unknown_values(decide):
    reason = lambda policy, **c: decide(policy, **c).first().skip_reason
    assert reason({}) is None
    assert reason({}, in_standby=None) == "in standby"
    assert reason({}, user_access="SINGLE_USER", is_accessible=None) == "single user and not accessible"
    assert reason({}, availability_group="ag", replica_role=None) == "full backup off the primary"
    assert reason({}, availability_group="ag", replica_role="PRIMARY") is None
    assert reason({"backup_type": "LOG"}, availability_group="ag") == "log backup off the preferred replica"
    assert reason({"backup_type": "LOG", "override_backup_preference": True}, availability_group="ag") is None
    assert reason({"backup_type": "LOG"}, recovery_model="SIMPLE") == "log backup in simple recovery"
    assert reason({"backup_type": "LOG"}, log_shipping_role="PRIMARY") == "log shipped"
    limits = {"backup_type": "LOG", "log_size_threshold_mb": 20, "log_time_threshold_s": 86401}
    assert reason(limits) == "too little log for a log backup"
    assert reason({**limits, "log_time_threshold_s": 86400}) is None
    assert reason(limits, log_size_mb=None) is None


def test_file_counts(decide):
    count = lambda policy, **c: decide(policy, **c).first().file_count
    assert count({"directory_count": 3}) == 3
    assert count({"number_of_files": 4, "min_size_for_multiple_mb": 7, "directory_count": 2}) == 4
    assert count({"number_of_files": 4, "min_size_for_multiple_mb": 8, "directory_count": 2}) == 2
    assert count({"max_file_size_mb": 1, "directory_count": 2}) == 8
    assert count({"max_file_size_mb": 1, "directory_count": 2}, allocated_pages=10_000_000) == 64
    assert count({"max_file_size_mb": 1, "backup_software": "SQLBACKUP"}, allocated_pages=10_000_000) == 32
    assert count({"backup_software": "DATA_DOMAIN_BOOST"}) == 1


def test_cleanup_is_cancelled_by_an_unknown_candidate(frame, decide):
    latest = frame("server_id int, name string, latest_backup timestamp", [(1, "db", dt.datetime(2024, 1, 2))])
    none = frame("server_id int, name string, latest_backup timestamp", [])
    cut = lambda policy, known: backup_rules.cleanup_cutoff(decide(policy), known, NOW).first().cleanup_before
    assert cut({"backup_type": "LOG", "cleanup_hours": 24}, latest) == dt.datetime(2024, 1, 2)
    assert cut({"backup_type": "LOG", "cleanup_hours": 24}, none) is None
    assert cut({"cleanup_hours": 24}, none) == dt.datetime(2024, 1, 30)
    assert cut({}, latest) is None


# ---- indexes -------------------------------------------------------------------------

INDEX = (
    "index_id int, index_type int, allow_page_locks boolean, is_image_text boolean, is_new_lob boolean, is_file_stream boolean, "
    "is_column_store boolean, is_memory_optimized boolean, on_read_only_filegroup boolean, resumable boolean, statistics_id int, "
    "is_incremental boolean, partition_number int, partition_count int, fragmentation double, page_count bigint, row_count bigint, "
    "modification_counter bigint"
)
INDEX_BASE = dict(
    index_id=1, index_type=1, allow_page_locks=True, is_image_text=False, is_new_lob=False, is_file_stream=False, is_column_store=False,
    is_memory_optimized=None, on_read_only_filegroup=False, resumable=False, statistics_id=1, is_incremental=False, partition_number=None,
    partition_count=None, fragmentation=50.0, page_count=1000, row_count=100, modification_counter=10,
)


@pytest.fixture
def plan(frame):
    def run(policy=None, **changes):
        df = frame(INDEX, [tuple({**INDEX_BASE, **changes}.values())])
        df = index_rules.with_policy_defaults(df.withColumns({k: F.lit(v) for k, v in (policy or {}).items()}))
        return index_rules.statistics_decision(index_rules.index_action(index_rules.fragmentation_group(df))).first()
    return run


def test_fragmentation_bounds(plan):
    group = lambda f: plan(fragmentation=f).fragmentation_group
    assert [group(f) for f in (30.0, 29.9, 5.0, 4.9, None)] == ["High", "Medium", "Medium", "Low", None]


def test_index_actions(plan):
    assert plan().action == "INDEX_REBUILD_ONLINE"
    assert plan({"online_capable": False}).action == "INDEX_REBUILD_OFFLINE"
    assert plan(fragmentation=10.0).action == "INDEX_REORGANIZE"
    assert plan(fragmentation=10.0, allow_page_locks=False).action == "INDEX_REBUILD_ONLINE"
    assert plan(fragmentation=10.0, allow_page_locks=False).max_dop == 1
    assert plan(fragmentation=1.0).action is None
    assert plan(page_count=999).action is None
    assert plan(page_count=999, resumable=True).action == "INDEX_REBUILD_ONLINE"
    assert plan(on_read_only_filegroup=True).action is None
    assert plan(index_type=5, allow_page_locks=False, is_column_store=True).action == "INDEX_REBUILD_OFFLINE"
    same = {f"fragmentation_{g}": "INDEX_REORGANIZE" for g in ("low", "medium", "high")}
    assert plan(same, fragmentation=None).action == "INDEX_REORGANIZE"


def test_statistics(plan):
    update = lambda policy, **c: plan(policy, **c).update_statistics_now
    assert update({}) is False
    assert update({"update_statistics": "ALL"}, fragmentation=1.0) is True
    assert update({"update_statistics": "ALL"}) is False, "already rebuilt"
    assert update({"update_statistics": "COLUMNS"}, index_id=None, index_type=None) is True
    assert update({"update_statistics": "INDEX"}, index_id=None, index_type=None) is False
    modified = {"update_statistics": "ALL", "only_modified_statistics": True}
    assert update(modified, fragmentation=1.0, modification_counter=0) is False
    level = {"update_statistics": "ALL", "statistics_modification_level": 11}
    assert update(level, fragmentation=1.0) is False
    assert update(level, fragmentation=1.0, modification_counter=11) is True
    assert update(level, fragmentation=1.0, row_count=0, modification_counter=1) is True
    assert update(level, fragmentation=1.0, row_count=10_000_000, modification_counter=100_000) is True
    assert update({"update_statistics": "ALL"}, fragmentation=1.0, partition_number=2, partition_count=3) is False
    assert update({"update_statistics": "ALL"}, partition_number=3, partition_count=3) is True


# ---- checks, commands, jobs ----------------------------------------------------------


def _inventory(frame):
    at = "server_id int, database_name string, object_id int, "
    kinds = {"index_type": 1, "allow_page_locks": True, "is_memory_optimized": False}
    columns = [c for c in INDEX.split(", ") if c.split()[0] not in ("partition_count", "fragmentation", "page_count", "row_count", "modification_counter", "index_id", "statistics_id")]
    made = {**INDEX_BASE, **kinds}
    row = lambda i, part: (1, "db", 7, i, i, "s", "t", f"ix{i}", f"ix{i}", *[part if c.startswith("partition_number") else made[c.split()[0]] for c in columns])
    schema = at + "index_id int, statistics_id int, schema_name string, object_name string, index_name string, statistics_name string, " + ", ".join(columns)
    indexes = frame(schema, [row(1, None), row(2, None), row(2, None)])
    policies = frame("server_id int, policy_id int, spec string, update_statistics string, partition_level_statistics boolean", [(1, 1, None, "ALL", True), (1, 2, "%.%.%.ix2", "ALL", False), (1, 2, "%.%.%.ix2", "ALL", False)])
    physical = frame(at + "index_id int, partition_number int, alloc_unit_type string, index_level int, page_count bigint, fragmentation double", [(1, "db", 7, 1, 1, "IN_ROW_DATA", 0, 5000, 50.0)])
    props = frame(at + "statistics_id int, row_count bigint, modification_counter bigint", [(1, "db", 7, 1, 100, 5), (1, "db", 7, 9, 50, 5)])
    alone = frame(at + "schema_name string, object_name string, statistics_id int, statistics_name string, is_incremental boolean", [(1, "db", 7, "s", "t", 9, "st9", True)])
    parts = frame(at + "statistics_id int, partition_number int, row_count bigint, modification_counter bigint", [(1, "db", 7, 9, k, 10 * k, k) for k in (1, 2)])
    return indexes, policies, physical, props, alone, parts


def test_policy_columns_do_not_travel_with_the_numbered_rows(frame, rows, monkeypatch):
    seen, number = [], selection.number_rows
    monkeypatch.setattr(selection, "number_rows", lambda df, *a: seen.append(df.columns) or number(df, *a))
    found = maintenance.index_plan(*_inventory(frame))
    assert not {"prefer_high", "fragmentation_medium", "update_statistics"} & set(seen[0])
    # Column statistics come per partition where the policy works on partitions, and the policy listed twice counts twice.
    assert rows(found, "policy_id", "index_id", "statistics_id", "partition_number", "row_count", "action", "plan_order", "update_statistics") == sorted([
        (1, 1, 1, None, 100, "INDEX_REBUILD_ONLINE", 1, "ALL"), (1, 2, 2, None, None, None, 2, "ALL"), (1, None, 9, 1, 10, None, 3, "ALL"), (1, None, 9, 2, 20, None, 4, "ALL"),
        (2, 2, 2, None, None, None, 1, "ALL"), (2, 2, 2, None, None, None, 2, "ALL"),
    ], key=repr)


def test_statistics_of_dealt_inputs_do_not_move_again(frame, rows):
    """Inputs in buckets by object: not one row is dealt by hash on the way to the decisions."""
    plain = _inventory(frame)
    dealt = [df if "object_id" not in df.columns else freeze_dealt(df, "object_id") for df in plain]
    columns = ["policy_id", "index_id", "statistics_id", "partition_number", "row_count", "page_count", "action", "update_statistics_now"]
    found = maintenance.index_decisions(*dealt)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, *columns) == rows(maintenance.index_decisions(*plain), *columns)
    assert len(rows(found, *columns)) == 6


def test_index_plan_of_dealt_inputs_packs_what_is_wanted(frame, rows, monkeypatch):
    """Only wanted columns and the order are written, and the rows of an object under a policy are dealt as one; same numbers."""
    seen, freeze = [], ranking.freeze
    monkeypatch.setattr(ranking, "freeze", lambda df: seen.append(df) or freeze(df))
    plain = _inventory(frame)
    wanted = ["policy_id", "index_id", "statistics_id", "partition_number", "action", "update_statistics", "plan_order"]
    dealt = [df if "object_id" not in df.columns else freeze_dealt(df, "object_id") for df in plain]
    found = maintenance.index_plan(*dealt, columns=wanted, by_object=True)
    assert found.columns == wanted and not {"page_count", "allow_page_locks", "row_count"} & set(seen[0].schema["_rows"].dataType.elementType.names)
    assert "Exchange hashpartitioning" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(len(r["_rows"]) for r in seen[0].collect()) == [1, 1, 2, 2], "by policy, the one listed twice counts twice, and by resumable, unknown for column statistics"
    assert rows(found, *wanted) == rows(maintenance.index_plan(*plain), *wanted)


def test_command_outcomes(frame, rows):
    t = dt.datetime(2024, 1, 1)
    log = frame("start_time timestamp, end_time timestamp, error_number bigint", [
        (t, t + dt.timedelta(days=2, hours=1, seconds=5), 0), (t, None, None), (t, t, 1222), (t.replace(microsecond=900000), t.replace(second=1), 50000),
    ])
    got = rows(checks.command_outcomes(log, 10), "outcome", "duration", "severity", "return_code")
    assert got == sorted([
        ("Succeeded", "2.01:00:05", None, 0), ("Not Executed", None, None, 0), ("Failed", "00:00:00", 10, 0), ("Failed", "00:00:01", 16, 50000),
    ], key=repr)


def definitions(frame, *changed):
    names = list(jobs.COMPARED)
    base = [tuple(changed[i].get(n, f"{n.upper()}{i}") for n in names) for i in range(len(changed))]
    return frame(", ".join(f"{n} string" for n in names), base)


def test_drift(frame, rows):
    a = definitions(frame, {}, {"run_as": None}, {"job_name": ""})
    assert jobs.definition_drift(a, a).count() == 0
    doubled = a.union(a)
    assert jobs.definition_drift(a, doubled).count() == 0, "duplicates are no drift"
    b = definitions(frame, {"job_name": "job_name0"}, {"run_as": "x"}, {"job_name": "", "run_as": "y"})
    assert rows(jobs.definition_drift(a, b), "side", "job_name", "run_as") == [
        ("primary", "job_name1", None), ("secondary", "job_name1", "x"),
    ]


def test_job_definitions_meet_on_one_key(frame, rows, spark):
    """Jobs, steps and schedules are dealt by job once; only the narrow steps are dealt by their targets."""
    jobs_ = frame(
        "server_id int, job_id string, name string, enabled int, owner_sid int, category_id int, description string, delete_level int, date_created timestamp, date_modified timestamp, originating_server_id int",
        [(1, j, j, 1, 1, 1, None, 0, NOW, NOW, 1) for j in ("a", "empty")],
    )
    steps = frame(
        "server_id int, job_id string, step_id int, step_name string, subsystem string, command string, database_name string, on_success_action int, on_success_step_id int, on_fail_action int, on_fail_step_id int, "
        "retry_attempts int, retry_interval int, proxy_id int", [(1, "a", i, f"s{i}", "TSQL", "x", "db", 4, i + 1, 4, i - 1, 0, 0, None) for i in (1, 2)],
    )
    schedules = frame(
        "server_id int, schedule_id int, name string, freq_type int, freq_interval int, freq_subday_type int, freq_subday_interval int, freq_relative_interval int, freq_recurrence_factor int, "
        "active_start_date int, active_end_date int, active_start_time int, active_end_time int, date_created timestamp, date_modified timestamp", [(1, 5, "nightly", 4, 1, 1, 0, 0, 0, 20240101, 99991231, 0, 0, NOW, NOW)],
    )
    named = lambda key: frame(f"server_id int, {key} int, name string", [(1, 1, "n")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = jobs.job_definition_view(
            jobs_, steps, schedules, frame("server_id int, job_id string, schedule_id int", [(1, "a", 5)]),
            named("category_id"), named("proxy_id"), named("owner_sid"), named("originating_server_id"),
        )
        plan = view._jdf.queryExecution().executedPlan().toString()
        by_job = [line for line in plan.splitlines() if "Exchange hashpartitioning(server_id" in line and ", job_id" in line]
        assert len(by_job) == 7, len(by_job)
        assert rows(view, "job_id", "step_no", "on_success_action", "on_failure_action", "job_schedule_name") == sorted([
            ("a", 1, "Go to Step: [2] s2", None, "nightly"), ("a", 2, None, "Go to Step: [1] s1", "nightly"), ("empty", None, None, None, None),
        ], key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_backup_templates_are_tidied_once_per_set_of_tokens(spark):
    """The patterns stand below an aggregate over the sets of tokens; unknown flags and repeated rows keep their rows."""
    rows = [
        ("db", "S1", None, "AG", "FULL", True, None, 2, None), ("db", "S1", "I", None, "LOG", None, True, 1, None),
        ("db", "S1", "I", None, "LOG", None, True, 1, None), ("x", None, None, None, "DIFF", False, False, None, ""), ("y", "S1", None, None, "FULL", False, False, 1, "{DatabaseName}/{Partial}"),
    ]
    decided = spark.createDataFrame(rows, (
        "name string, server_name string, instance_name string, availability_group string, decided_backup_type string, copy_only boolean, "
        "read_write_filegroups boolean, file_count bigint, directory_structure string"
    ))
    found = backup_rules.backup_path_parts(decided, dt.datetime(2024, 1, 31))
    assert sorted((r["directory"], r["file_template"]) for r in found.collect()) == sorted([
        (r"AG\db\FULL_PARTIAL_COPY_ONLY", "AG_{DatabaseName}_FULL_PARTIAL_COPY_ONLY_20240131_000000_{FileNumber}.bak"),
        *[(r"S1$I\db\LOG_PARTIAL_COPY_ONLY", "S1$I_{DatabaseName}_LOG_PARTIAL_COPY_ONLY_20240131_000000.trn")] * 2,
        ("", "_{DatabaseName}_DIFF_20240131_000000_{FileNumber}.bak"), (r"y", "S1_{DatabaseName}_FULL_20240131_000000.bak"),
    ])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "regexp_replace" not in plan.split("Aggregate")[0].split("Join")[0]
