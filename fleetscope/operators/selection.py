"""Which databases, objects and indexes a policy selects, and in which order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import name_matches
from fleetscope.functions.templates import file_system_name
from fleetscope.operators.ranking import number_rows
from fleetscope.sources.selectors import expand_selectors, selector_array

PARTS = {
    "databases": ["name"],
    "groups": ["name"],
    "filegroups": ["database_name", "filegroup_name"],
    "objects": ["database_name", "schema_name", "object_name"],
    "indexes": ["database_name", "schema_name", "object_name", "index_name"],
}

# Databases that count as system databases.
SYSTEM_DATABASES = ("master", "msdb", "model")


def database_names(databases: DataFrame) -> DataFrame:
    """Selectable databases with their type, group membership and file-system name.

    Temp space and snapshots of other databases are never selected.
    """
    system = F.lower("name").isin(*SYSTEM_DATABASES) | F.coalesce("is_distributor", F.lit(False))
    return databases.filter((F.lower("name") != "tempdb") & F.col("source_database_id").isNull()).withColumns({
        "database_type": F.when(system, "S").otherwise("U"),
        "in_group": F.coalesce("in_group", F.lit(False)),
        "file_system_name": file_system_name(F.col("name")),
    })


def resolve_selection(names: DataFrame, policies: DataFrame, kind: str = "databases", delimiter: str = ",", by: Sequence[str] = ("server_id",)) -> DataFrame:
    """Names with ``selected`` and ``start_position`` per policy.

    Includes apply first, then excludes override them; the position is that of the first
    matching include. A policy without a list selects everything. Each name meets its
    policies through an equi-join, and the pattern list of a policy is tested inside the
    row, so no names-by-patterns product is ever formed.
    """
    def lowered(selector: Column) -> Column:
        flags = ["database_type", "in_group"] if kind == "databases" else []
        return F.struct(
            *[selector[f].alias(f) for f in ["position", "selected", *flags]],
            *[F.lower(selector[part]).alias(part) for part in PARTS[kind]],
        )

    selectors = F.transform(selector_array(F.col("spec"), kind, delimiter), lowered)
    parsed = policies.withColumn("_selectors", selectors).drop("spec")
    joined = names.withColumns({f"_{part}": F.lower(part) for part in PARTS[kind]}).join(parsed, list(by))

    def matches(selector: Column) -> Column:
        test = None
        if kind == "databases":
            test = selector["database_type"].isNull() | (selector["database_type"] == F.col("database_type"))
            test = test & (selector["in_group"].isNull() | (selector["in_group"] == F.col("in_group")))
        for part in PARTS[kind]:
            one = F.coalesce(name_matches(F.col(f"_{part}"), selector[part]), F.lit(False))
            test = one if test is None else test & one
        return test

    joined = joined.withColumn("_hits", F.filter("_selectors", matches))
    included = F.filter("_hits", lambda s: s["selected"])
    excluded = F.exists("_hits", lambda s: ~s["selected"])
    everything = F.col("_selectors").isNull()
    return joined.withColumns({
        "selected": everything | ((F.size(included) > 0) & ~excluded),
        "start_position": F.array_min(F.transform(included, lambda s: s["position"])),
    }).drop("_selectors", "_hits", *[f"_{part}" for part in PARTS[kind]])


def missing_selectors(names: DataFrame, policies: DataFrame, delimiter: str = ",", kind: str = "databases") -> DataFrame:
    """Plain names in a list of any kind that no database, group, filegroup, object or index has.

    A name of several parts is plain if none of them holds a wildcard; it is told with dots.
    """
    parts = PARTS[kind]
    plain = [F.col(p).isNotNull() & ~F.contains(p, F.lit("%")) for p in parts]
    literal = expand_selectors(policies, kind, delimiter).filter(reduce(lambda a, b: a & b, plain))
    keys = [f"_{p}" for p in parts]
    lowered = {k: F.lower(p) for k, p in zip(keys, parts)}
    known = names.select("server_id", *[column.alias(k) for k, column in lowered.items()]).dropna(subset=keys).distinct()
    return (
        literal.withColumns(lowered).join(known, ["server_id", *keys], "left_anti")
        .select("server_id", "policy_id", "position", F.concat_ws(".", *parts).alias("missing_name"))
    )


def missing_selectors_text(missing: DataFrame) -> DataFrame:
    """One warning text per policy; a policy's list is a single text to begin with."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "missing_name"))), lambda s: F.concat(F.lit("["), s["missing_name"], F.lit("]")))
    return missing.groupBy("server_id", "policy_id").agg(F.array_join(names, ", ").alias("missing_names"))


def ambiguous_names(selected: DataFrame) -> DataFrame:
    """Databases whose file-system names collide, where a selected one is involved."""
    keyed = selected.filter("file_system_name <> ''").withColumn("_key", F.upper("file_system_name"))
    at = ["server_id", "policy_id", "_key"]
    clashes = keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.max("selected").alias("_any")).filter("_n > 1 and _any")
    return keyed.join(clashes.select(*at), at, "left_semi").drop("_key")


# How selected databases may be ordered; NULLs come first when ascending.
DATABASE_ORDERS = {
    None: ["start_position", "name"],
    "DATABASE_NAME_ASC": ["name"],
    "DATABASE_NAME_DESC": ["-name"],
    "DATABASE_SIZE_ASC": ["database_pages", "name"],
    "DATABASE_SIZE_DESC": ["-database_pages", "name"],
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP_ASC": ["log_size_mb", "name"],
    "LOG_SIZE_SINCE_LAST_LOG_BACKUP_DESC": ["-log_size_mb", "name"],
    "DATABASE_LAST_GOOD_CHECK_ASC": ["last_good_check", "name"],
    "DATABASE_LAST_GOOD_CHECK_DESC": ["-last_good_check", "name"],
    "REPLICA_LAST_GOOD_CHECK_ASC": ["last_command_time", "name"],
    "REPLICA_LAST_GOOD_CHECK_DESC": ["-last_command_time", "name"],
}
INDEX_ORDER = [
    "-resumable", "start_position", "database_name", "schema_name", "object_name", "is_statistics_only", "index_type",
    "index_name", "statistics_name", "partition_number",
]
FILEGROUP_ORDER = ["start_position", "database_name", "filegroup_name"]
OBJECT_ORDER = ["start_position", "database_name", "schema_name", "object_name"]


def _sort_columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_first() for n in names]


def plan_order(
    selected: DataFrame, order: str | Sequence[str] | None = None, by: Sequence[str] = ("server_id", "policy_id"), packed: Sequence[str] = (),
) -> DataFrame:
    """Number the selected rows of each server and policy in working order.

    ``order`` names one of the database orders or lists columns (a leading ``-`` sorts
    descending). Rows that share the columns of ``packed`` beside ``by`` travel together.
    """
    columns = DATABASE_ORDERS[order] if order is None or isinstance(order, str) else order
    rows = selected.filter("selected")
    if not packed:
        return number_rows(rows, list(by), _sort_columns(columns), "plan_order")
    leading = len([*takewhile(lambda n: n.removeprefix("-") in packed, columns)])
    return number_rows(rows, list(by), _sort_columns(columns), "plan_order", False, [*by, *packed], leading)
