"""Maintenance plans: what should run, in which order, and why the rest should not."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators import backup_rules, checks, index_rules, selection
from fleetscope.operators.ranking import exists_flag, join_in_place, number_rows
from fleetscope.runtime import freeze


def _selected(databases: DataFrame, policies: DataFrame) -> DataFrame:
    return selection.resolve_selection(selection.database_names(databases), policies, "databases").filter("selected")


def _resolved_by_group(names: DataFrame, policies: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Databases with ``selected`` per policy: by the groups a policy lists in ``group_spec``, else by its database list."""
    if groups is None or "group_spec" not in policies.columns:
        return selection.resolve_selection(names, policies)
    by_name = selection.resolve_selection(names, policies.filter("group_spec is null").drop("group_spec"))
    listed = policies.filter("group_spec is not null").drop("spec")
    found = selection.resolve_selection(groups, listed.withColumnRenamed("group_spec", "spec"), "groups")
    found = found.select("server_id", "policy_id", F.col("name").alias("availability_group"), "selected", "start_position")
    own = names.join(listed.drop("group_spec"), "server_id").join(found, ["server_id", "policy_id", "availability_group"], "left")
    return by_name.unionByName(own.withColumn("selected", F.coalesce("selected", F.lit(False))), allowMissingColumns=True)


def backup_plan(
    databases: DataFrame, policies: DataFrame, backupset: DataFrame, now: datetime, order: str | None = None,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Backup type, eligibility, size, files, paths and cleanup cut of each selected database.

    With ``groups`` (server_id, name) a policy may list availability groups in
    ``group_spec`` instead of databases. ``is_ambiguous`` marks databases whose file-system name
    another one shares; ``missing_names`` tells what the policy lists and no one has.
    """
    full = backup_rules.with_policy_defaults(policies)
    names = selection.database_names(databases)
    resolved = _resolved_by_group(names, full, groups)
    decided = backup_rules.backup_eligibility(backup_rules.backup_type_decision(resolved.filter("selected")), now)
    sized = backup_rules.backup_file_count(decided)
    latest = backup_rules.latest_restorable_backup(backupset, databases)
    dated = backup_rules.cleanup_cutoff(sized, latest, now)
    at = ["server_id", "policy_id"]
    clashes = selection.ambiguous_names(resolved).select(*at, F.upper("file_system_name").alias("_key"))
    flagged = exists_flag(dated.withColumn("_key", F.upper("file_system_name")), clashes, [*at, "_key"], "is_ambiguous").drop("_key")
    by_group = groups is not None and "group_spec" in policies.columns
    missing = selection.missing_selectors(names, _lists(policies.filter("group_spec is null") if by_group else policies, "spec"))
    if by_group:
        missing = missing.unionByName(selection.missing_selectors(groups, _lists(policies, "group_spec"), kind="groups"))
    warned = flagged.join(selection.missing_selectors_text(missing), at, "left")
    # Paths come last, so what is frozen to number the rows is narrow and the rows that need them are there.
    ordered = selection.plan_order(warned, order)
    last = [c for c in ordered.columns if c not in dated.columns]
    parts = backup_rules.backup_path_parts(ordered, now)
    return parts.select(*[c for c in parts.columns if c not in last], *last)


def _lists(policies: DataFrame, column: str) -> DataFrame:
    return policies.select("server_id", "policy_id", F.col(column).alias("spec"))


def backup_files(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per file of the backups that may run."""
    eligible = plan.filter("skip_reason is null")
    return backup_rules.backup_paths(backup_rules.stripe_numbers(eligible, targets))


def integrity_plan(
    databases: DataFrame, policies: DataFrame, command_log: DataFrame, order: str | None = None,
) -> DataFrame:
    """Check commands of each selected database, with the reason where none may run."""
    last = checks.last_success(command_log, "DBCC_CHECKDB").withColumnRenamed("database_name", "name")
    chosen = _selected(databases, policies).join(last, ["server_id", "name"], "left")
    planned = selection.plan_order(
        checks.integrity_check_eligibility(chosen), order
    )
    return checks.expand_check_commands(planned)


def integrity_targets(plan: DataFrame, policies: DataFrame, filegroups: DataFrame, objects: DataFrame) -> DataFrame:
    """Commands of an integrity plan with what each works on, numbered in working order.

    A file group check has a row per selected file group of its database, a table check per
    selected object; policies list them as ``filegroup_spec`` and ``object_spec``, no list
    selects all. Only databases of the plan are looked at, so what excludes a database
    excludes all in it. A command without a selected target has no row; one that is skipped
    keeps its row and reason.
    """
    def of(command: str, kind: str, names: DataFrame, spec: str, parts: list[str]) -> DataFrame:
        own = plan.filter((F.col("check_command") == command) & F.col("skip_reason").isNull())
        wanted = F.col(spec) if spec in policies.columns else F.lit(None).cast("string")
        lists = policies.select("server_id", "policy_id", wanted.alias("spec"))
        asked = own.select("server_id", F.col("name").alias("database_name")).distinct()
        inside = names.select("server_id", "database_name", *parts).join(asked, ["server_id", "database_name"], "left_semi")
        chosen = selection.resolve_selection(inside, lists, kind).filter("selected").select(
            "server_id", "policy_id", F.col("database_name").alias("name"), *parts, F.col("start_position").alias("target_position")
        )
        return own.join(chosen, ["server_id", "policy_id", "name"])

    nested = F.col("check_command").isin("CHECKFILEGROUP", "CHECKTABLE") & F.col("skip_reason").isNull()
    rows = plan.filter(~nested).unionByName(
        of("CHECKFILEGROUP", "filegroups", filegroups, "filegroup_spec", ["filegroup_name"]), allowMissingColumns=True
    ).unionByName(of("CHECKTABLE", "objects", objects, "object_spec", ["schema_name", "object_name"]), allowMissingColumns=True)
    order = ["plan_order", "check_command", "target_position", "filegroup_name", "schema_name", "object_name"]
    return number_rows(rows, ["server_id", "policy_id"], [F.col(c).asc_nulls_first() for c in order], "target_order")


def _slim_decisions(
    indexes: DataFrame, policies: DataFrame, index_physical: DataFrame, stats_props: DataFrame,
    column_statistics: DataFrame | None, incremental_props: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """Decisions without the columns of their policies but ``_policy``, and the policies under that id."""
    at = ["server_id", "database_name", "object_id", "index_id"]
    rules = freeze(index_rules.with_policy_defaults(policies).withColumn("_policy", F.monotonically_increasing_id()))
    of_rules = [c for c in rules.columns if c not in ("server_id", "policy_id", "spec", "_policy")]
    late = [c for c in of_rules if c != "partition_level_statistics"]
    rows = indexes if column_statistics is None else index_rules.index_and_statistics(indexes, column_statistics)
    rows = join_in_place(rows, index_rules.partition_counts(indexes), at)
    found = index_rules.whole_and_partition_fragmentation(index_rules.index_fragmentation(index_physical))
    in_split = column_statistics is not None and incremental_props is not None

    def measured(part: DataFrame, of: Column) -> DataFrame:
        return join_in_place(part, found.filter(of), [*at, "partition_number"])

    def selected(part: DataFrame) -> DataFrame:
        named = part.withColumns({"_own_name": F.col("index_name"), "index_name": F.coalesce("index_name", "statistics_name")})
        chosen = selection.resolve_selection(named, rules, "indexes").filter("selected")
        return chosen.withColumn("index_name", F.col("_own_name")).drop("_own_name").filter(index_rules.in_scope())

    # Each index is measured once, however many policies select it; a column statistic where its partitions depend on the policy comes later.
    if incremental_props is None:
        rows = index_rules.with_modifications(rows, stats_props)
    if not in_split:
        chosen = selected(measured(rows, F.lit(True))).drop(*late)
    else:
        is_index = F.col("index_id").isNotNull()
        own = selected(measured(rows.filter(is_index), is_index)).drop(*late)
        alone = selected(rows.filter(~is_index)).drop(*late)
        alone = measured(index_rules.partitions_of_statistics(alone, incremental_props), ~is_index)
        chosen = own.unionByName(alone)
    if incremental_props is not None:
        chosen = index_rules.with_modifications(chosen, stats_props, incremental_props)
    return chosen.drop("partition_level_statistics"), rules.select("_policy", *of_rules)


def index_decisions(
    indexes: DataFrame, policies: DataFrame, index_physical: DataFrame, stats_props: DataFrame,
    column_statistics: DataFrame | None = None, incremental_props: DataFrame | None = None,
) -> DataFrame:
    """Action and statistics update of each selected index and, where given, column statistic.

    Policies carry the index list as ``spec``; it names a column statistic as it names an index.
    Inventory, fragmentation and statistics meet on their natural keys, an index once for all
    its policies; the columns of a policy travel as its id. A row without partition number is a whole index
    and is judged by its worst partition and all pages. ``incremental_props`` has rows and
    changes per partition: policies on partition level judge incremental statistics by them.
    """
    slim, rules = _slim_decisions(indexes, policies, index_physical, stats_props, column_statistics, incremental_props)
    return _decided(slim.join(rules, "_policy")).drop("_policy")


def _decided(measured: DataFrame) -> DataFrame:
    decided = index_rules.index_action(index_rules.fragmentation_group(measured))
    return index_rules.statistics_decision(decided).withColumn("is_statistics_only", F.col("index_type").isNull())


def index_plan(
    indexes: DataFrame, policies: DataFrame, index_physical: DataFrame, stats_props: DataFrame,
    column_statistics: DataFrame | None = None, incremental_props: DataFrame | None = None,
    columns: Sequence[str] | None = None, by_object: bool = False,
) -> DataFrame:
    """Decisions per index and column statistic, numbered in working order.

    ``columns`` lists what is wanted of them, so that the rest is not written to number the rows.
    With ``by_object``, for inputs that are dealt by ``object_id``, the rows of an object under a
    policy travel together.
    """
    slim, rules = _slim_decisions(indexes, policies, index_physical, stats_props, column_statistics, incremental_props)
    decided = _decided(slim.join(rules, "_policy")).drop(*[c for c in rules.columns if c != "_policy"])
    of_object = ["_policy", *[c.removeprefix("-") for c in selection.INDEX_ORDER[:5]], "object_id"] if by_object else []
    if columns is not None:
        needed = ["server_id", "policy_id", "_policy", "selected", *of_object, *[c.removeprefix("-") for c in selection.INDEX_ORDER]]
        decided = decided.select(*dict.fromkeys([*needed, *[c for c in columns if c in decided.columns]]))
    ordered = selection.plan_order(decided, selection.INDEX_ORDER, packed=of_object).join(rules, "_policy").drop("_policy")
    return ordered if columns is None else ordered.select(*columns)


def command_report(command_log: DataFrame, lock_message_severity: int = 16) -> DataFrame:
    """Outcomes, failures and total time per server, database and command type."""
    rows = checks.command_outcomes(command_log, lock_message_severity)
    return rows.groupBy("server_id", "database_name", "command_type").agg(
        F.count(F.lit(1)).alias("commands"),
        F.count(F.when(F.col("outcome") == "Succeeded", 1)).alias("succeeded"),
        F.count(F.when(F.col("outcome") == "Failed", 1)).alias("failed"),
        F.count(F.when(F.col("outcome") == "Not Executed", 1)).alias("not_executed"),
        F.sum("duration_seconds").alias("total_seconds"),
        F.max(F.when(F.col("outcome") == "Succeeded", F.col("start_time"))).alias("last_success"),
    )
