"""Queries on selection rules and maintenance plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fleetscope.operators import backup_rules, checks, index_rules, selection
from fleetscope.plans import maintenance
from fleetscope.sources.selectors import expand_selectors, first_occurrence
from harness.core import query

NOW = datetime(2024, 1, 31)
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# ---- selectors and selection ---------------------------------------------------------

_ITEMS_SQL = """
items AS (
  SELECT server_id, policy_id, u.position, trim(u.item) AS item
  FROM fx_policies, (SELECT unnest(string_split(spec, ',')) AS item, unnest(range(1, len(string_split(spec, ',')) + 1)) AS position) u
  WHERE spec IS NOT NULL),
bare AS (SELECT *, NOT starts_with(item, '-') AS selected, CASE WHEN starts_with(item, '-') THEN item[2:] ELSE item END AS word FROM items),
selectors AS (
  SELECT server_id, policy_id, position, item, selected,
         CASE word WHEN 'SYSTEM_DATABASES' THEN 'S' WHEN 'USER_DATABASES' THEN 'U' END AS database_type,
         CASE WHEN word = 'AVAILABILITY_GROUP_DATABASES' THEN TRUE END AS in_group,
         CASE WHEN word LIKE '%!_DATABASES' ESCAPE '!' THEN '%' WHEN starts_with(word, '[') THEN word[2:-2] ELSE word END AS name
  FROM bare)
"""
_SELECTION_SQL = _ITEMS_SQL + """,
names AS (
  SELECT *, CASE WHEN lower(name) IN ('master', 'msdb', 'model') OR is_distributor THEN 'S' ELSE 'U' END AS database_type
  FROM fx_databases WHERE lower(name) <> 'tempdb' AND source_database_id IS NULL),
hits AS (
  SELECT n.server_id, n.database_id, s.policy_id, bool_or(s.selected) AND NOT bool_or(NOT s.selected) AS picked,
         min(CASE WHEN s.selected THEN s.position END) AS start_position
  FROM names n JOIN selectors s ON s.server_id = n.server_id
   AND lower(n.name) LIKE replace(lower(s.name), '_', '!_') ESCAPE '!'
   AND (s.database_type IS NULL OR s.database_type = n.database_type) AND (s.in_group IS NULL OR s.in_group = n.in_group)
  GROUP BY ALL),
resolved AS (
  SELECT n.*, p.* EXCLUDE (server_id), p.spec IS NULL OR coalesce(h.picked, FALSE) AS selected, h.start_position
  FROM names n JOIN fx_policies p USING (server_id)
  LEFT JOIN hits h ON h.server_id = n.server_id AND h.database_id = n.database_id AND h.policy_id = p.policy_id)
"""


@query("expand_selectors", "WITH " + _ITEMS_SQL + "SELECT * FROM selectors")
def _(v):
    rows = expand_selectors(v("fx_policies").select("server_id", "policy_id", "spec"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("first_occurrence", "WITH " + _ITEMS_SQL + """
SELECT server_id, name, min(position) AS position FROM selectors GROUP BY ALL
""")
def _(v):
    rows = expand_selectors(v("fx_policies").select("server_id", "spec", "policy_id"))
    return first_occurrence(rows, ["server_id", "name"]).select("server_id", "name", F.col("position").cast("bigint").alias("position"))


def _resolved(v):
    return selection.resolve_selection(selection.database_names(v("fx_databases")), v("fx_policies"))


@query("resolve_selection", "WITH " + _SELECTION_SQL + "SELECT server_id, policy_id, database_id, name, selected, start_position FROM resolved")
def _(v):
    return _resolved(v).select(
        "server_id", "policy_id", "database_id", "name", "selected", F.col("start_position").cast("bigint").alias("start_position")
    )


@query("missing_selectors", "WITH " + _ITEMS_SQL + """
SELECT s.server_id, s.policy_id, s.position, s.name AS missing_name FROM selectors s
WHERE s.name NOT LIKE '%!%%' ESCAPE '!' AND NOT EXISTS (SELECT 1 FROM fx_databases d WHERE d.server_id = s.server_id AND lower(d.name) = lower(s.name))
""")
def _(v):
    rows = selection.missing_selectors(v("fx_databases"), v("fx_policies").select("server_id", "policy_id", "spec"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("missing_selectors_text", "WITH " + _ITEMS_SQL + """
SELECT s.server_id, s.policy_id, string_agg('[' || s.name || ']', ', ' ORDER BY s.position) AS missing_names FROM selectors s
WHERE s.name NOT LIKE '%!%%' ESCAPE '!' AND NOT EXISTS (SELECT 1 FROM fx_databases d WHERE d.server_id = s.server_id AND lower(d.name) = lower(s.name))
GROUP BY ALL
""")
def _(v):
    missing = selection.missing_selectors(v("fx_databases"), v("fx_policies").select("server_id", "policy_id", "spec"))
    return selection.missing_selectors_text(missing)


@query("ambiguous_names", "WITH " + _SELECTION_SQL + """,
fs AS (SELECT *, upper(rtrim(regexp_replace(substr(name, 1, 16), '[\\\\/:*?"<>|#]', '', 'g'))) AS k FROM resolved)
SELECT server_id, policy_id, database_id, name FROM fs
WHERE (server_id, policy_id, k) IN (SELECT (server_id, policy_id, k) FROM fs GROUP BY server_id, policy_id, k HAVING count(*) > 1 AND bool_or(selected))
""")
def _(v):
    # Shortened names collide; the full ones do not.
    rows = _resolved(v).withColumn("file_system_name", F.replace(F.substring("name", 1, 16), F.lit("#"), F.lit("")))
    return selection.ambiguous_names(rows).select("server_id", "policy_id", "database_id", "name")


_ORDERED_SQL = _SELECTION_SQL + """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY server_id, policy_id ORDER BY start_position NULLS FIRST, name, database_id) AS plan_order FROM resolved WHERE selected)
"""


@query("plan_order", "WITH " + _SELECTION_SQL + """
SELECT server_id, policy_id, database_id, row_number() OVER (PARTITION BY server_id, policy_id ORDER BY database_pages DESC NULLS LAST, name) AS plan_order FROM resolved WHERE selected
""")
def _(v):
    rows = selection.plan_order(_resolved(v), "DATABASE_SIZE_DESC")
    return rows.select("server_id", "policy_id", "database_id", F.col("plan_order").cast("bigint").alias("plan_order"))


@query("resolve_objects", """
SELECT DISTINCT server_id, database_name, schema_name, object_name,
       (database_name LIKE 'db1%' OR (schema_name = 'schema2' AND object_name LIKE 'part%7')) AND NOT (database_name LIKE 'db%' AND object_name LIKE '%77') AS selected
FROM fx_indexes
""")
def _(v):
    objects = v("fx_indexes").select("server_id", "database_name", "schema_name", "object_name").distinct()
    policies = objects.select("server_id").distinct().withColumn("spec", F.lit("db1%.%.%, %.schema2.part%7,-db%.%.%77"))
    return selection.resolve_selection(objects, policies, "objects").drop("start_position")


@query("resolve_filegroups", """
SELECT DISTINCT server_id, database_name, coalesce(filegroup_name, 'NONE') AS filegroup_name,
       NOT (database_name = 'db3' AND filegroup_name = 'PRIMARY') IS TRUE AS selected FROM (SELECT server_id, database_name, filegroup_name FROM fx_files)
""".replace("NOT (database_name = 'db3' AND filegroup_name = 'PRIMARY') IS TRUE", "NOT (database_name = 'db3' AND coalesce(filegroup_name, 'NONE') = 'PRIMARY')"))
def _(v):
    groups = v("fx_files").select("server_id", "database_name", F.coalesce("filegroup_name", F.lit("NONE")).alias("filegroup_name")).distinct()
    policies = groups.select("server_id").distinct().withColumn("spec", F.lit("ALL_FILEGROUPS, -db3.primary"))
    return selection.resolve_selection(groups, policies, "filegroups").drop("start_position")


@query("resolve_groups", """
SELECT server_id, database_id, availability_group NOT IN ('group1a', 'group1b') AND availability_group NOT LIKE '%5b' AS selected
FROM fx_databases WHERE availability_group IS NOT NULL
""")
def _(v):
    named = v("fx_database_groups")
    policies = named.select("server_id").distinct().withColumn("spec", F.lit("ALL_AVAILABILITY_GROUPS,-GROUP1a,-group1B,-%5b"))
    groups = selection.resolve_selection(named, policies, "groups").select("server_id", F.col("name").alias("availability_group"), "selected")
    return v("fx_databases").join(groups, ["server_id", "availability_group"]).select("server_id", "database_id", "selected")


@query("missing_groups", """
SELECT server_id, 1 AS policy_id, 'Group9z' AS missing_name FROM fx_database_groups GROUP BY ALL
""")
def _(v):
    policies = v("fx_database_groups").select("server_id").distinct().withColumns({"policy_id": F.lit(1), "spec": F.lit("GROUP%,Group9z,-%b")})
    return selection.missing_selectors(v("fx_database_groups"), policies, kind="groups").drop("position")


@query("missing_objects", """
SELECT server_id, 1 AS policy_id, n AS missing_name FROM (SELECT DISTINCT server_id FROM fx_indexes), (VALUES ('db1.schema0.part0'), ('db9.schema1.Part1')) t(n)
""")
def _(v):
    objects = v("fx_indexes").select("server_id", "database_name", "schema_name", "object_name").distinct()
    spec = F.lit("db1.schema0.part0,db9.schema1.Part1,db1.schema%.part1,ALL_INDEXES")
    policies = objects.select("server_id").distinct().withColumns({"policy_id": F.lit(1), "spec": spec})
    return selection.missing_selectors(objects, policies, kind="objects").drop("position")


# ---- backup rules --------------------------------------------------------------------

_DECIDED_SQL = _SELECTION_SQL + """,
step1 AS (
  SELECT *, CASE WHEN change_backup_type AND backup_type = 'LOG' AND recovery_model IN ('FULL', 'BULK_LOGGED') AND log_lsn IS NULL AND name <> 'master' THEN 'DIFF' ELSE backup_type END AS t1
  FROM resolved WHERE selected),
step2 AS (
  SELECT *, CASE WHEN change_backup_type AND t1 = 'DIFF' AND (name = 'master' OR differential_base_lsn IS NULL
                      OR (allocated_pages > 0 AND modified_pages * 100 >= modification_level * allocated_pages)) THEN 'FULL' ELSE t1 END AS t2 FROM step1),
decided AS (SELECT *, CASE WHEN change_backup_type AND t2 = 'DIFF' AND differential_base_is_snapshot THEN 'FULL' ELSE t2 END AS kind FROM step2)
"""


def _decided(v):
    chosen = selection.resolve_selection(
        selection.database_names(v("fx_databases")), backup_rules.with_policy_defaults(v("fx_policies"))
    ).filter("selected")
    return backup_rules.backup_type_decision(chosen)


@query("backup_type_decision", "WITH " + _DECIDED_SQL + "SELECT server_id, policy_id, database_id, kind AS decided_backup_type FROM decided")
def _(v):
    return _decided(v).select("server_id", "policy_id", "database_id", "decided_backup_type")


_SKIP_SQL = f"""CASE
  WHEN state <> 'ONLINE' THEN 'not online'
  WHEN user_access = 'SINGLE_USER' AND NOT is_accessible THEN 'single user and not accessible'
  WHEN in_standby THEN 'in standby'
  WHEN kind = 'LOG' AND recovery_model = 'SIMPLE' THEN 'log backup in simple recovery'
  WHEN kind = 'LOG' AND log_lsn IS NULL THEN 'no log backup chain'
  WHEN kind = 'DIFF' AND differential_base_lsn IS NULL THEN 'no differential base'
  WHEN kind <> 'FULL' AND name = 'master' THEN 'master supports full backups only'
  WHEN availability_group IS NOT NULL AND kind = 'FULL' AND NOT copy_only AND coalesce(replica_role, '') <> 'PRIMARY' THEN 'full backup off the primary'
  WHEN availability_group IS NOT NULL AND kind = 'FULL' AND copy_only AND NOT coalesce(is_preferred_replica, FALSE) THEN 'copy-only full backup off the preferred replica'
  WHEN availability_group IS NOT NULL AND kind = 'DIFF' AND coalesce(replica_role, '') <> 'PRIMARY' THEN 'differential backup off the primary'
  WHEN availability_group IS NOT NULL AND kind = 'LOG' AND NOT copy_only AND NOT coalesce(is_preferred_replica, FALSE) THEN 'log backup off the preferred replica'
  WHEN availability_group IS NOT NULL AND kind = 'LOG' AND copy_only AND coalesce(replica_role, '') <> 'PRIMARY' THEN 'copy-only log backup off the primary'
  WHEN log_shipping_role = 'PRIMARY' AND kind = 'LOG' THEN 'log shipped'
  WHEN is_read_only AND updateability = 'READ_WRITE' THEN 'read-only database'
  WHEN NOT is_read_only AND updateability = 'READ_ONLY' THEN 'read-write database'
  WHEN kind = 'LOG' AND log_size_threshold_mb IS NOT NULL AND log_time_threshold_s IS NOT NULL
       AND NOT (coalesce(log_size_mb >= log_size_threshold_mb, TRUE) OR coalesce(date_diff('second', last_log_backup, {_NOW}) >= log_time_threshold_s, TRUE)) THEN 'too little log for a log backup'
  END"""


@query("backup_eligibility", "WITH " + _DECIDED_SQL + f"SELECT server_id, policy_id, database_id, {_SKIP_SQL} AS skip_reason FROM decided")
def _(v):
    return backup_rules.backup_eligibility(_decided(v), NOW).select("server_id", "policy_id", "database_id", "skip_reason")


_SIZED_SQL = _DECIDED_SQL + """,
bytes AS (SELECT *, CASE kind WHEN 'FULL' THEN coalesce(allocated_pages, database_pages) * 8192 WHEN 'DIFF' THEN modified_pages * 8192 ELSE log_size_mb * 1048576 END AS backup_bytes FROM decided),
sized AS (
  SELECT *, CAST(CASE WHEN number_of_files IS NULL AND max_file_size_mb IS NULL THEN directory_count
       WHEN number_of_files = 1 THEN 1
       WHEN number_of_files > 1 AND (min_size_for_multiple_mb IS NULL OR backup_bytes IS NULL OR backup_bytes >= min_size_for_multiple_mb * 1048576) THEN number_of_files
       WHEN number_of_files > 1 THEN directory_count
       WHEN backup_bytes IS NULL OR backup_bytes = 0 THEN directory_count
       ELSE least((backup_bytes // directory_count) // (max_file_size_mb * 1048576) + CASE WHEN (backup_bytes // directory_count) % (max_file_size_mb * 1048576) = 0 THEN 0 ELSE 1 END, 64 // directory_count) * directory_count END AS BIGINT) AS file_count
  FROM bytes)
"""


@query("backup_file_count", "WITH " + _SIZED_SQL + "SELECT server_id, policy_id, database_id, backup_bytes, file_count FROM sized")
def _(v):
    return backup_rules.backup_file_count(_decided(v)).select("server_id", "policy_id", "database_id", "backup_bytes", "file_count")


_LATEST_SQL = """
latest AS (
  SELECT b.server_id, b.database_name AS name, max(b.backup_start_date) AS latest_backup
  FROM fx_backups b JOIN (SELECT DISTINCT server_id, name, differential_base_lsn FROM fx_databases) d ON d.server_id = b.server_id AND d.name = b.database_name
  WHERE NOT b.is_damaged AND (b.type IN ('D', 'I') OR (b.type = 'L' AND b.last_lsn < d.differential_base_lsn)) GROUP BY ALL)
"""


@query("latest_restorable_backup", "WITH " + _LATEST_SQL + "SELECT * FROM latest")
def _(v):
    return backup_rules.latest_restorable_backup(v("fx_backups"), v("fx_databases"))


_CUTOFF = f"""CASE WHEN cleanup_hours IS NULL OR (kind = 'LOG' AND latest_backup IS NULL) THEN NULL
     WHEN kind = 'LOG' THEN least({_NOW}, latest_backup, {_NOW} - cleanup_hours * INTERVAL '1' HOUR) ELSE least({_NOW}, {_NOW} - cleanup_hours * INTERVAL '1' HOUR) END"""


@query("cleanup_cutoff", "WITH " + _DECIDED_SQL + ", " + _LATEST_SQL + f"""
SELECT server_id, policy_id, database_id, {_CUTOFF} AS cleanup_before FROM decided LEFT JOIN latest USING (server_id, name)
""")
def _(v):
    latest = backup_rules.latest_restorable_backup(v("fx_backups"), v("fx_databases"))
    return backup_rules.cleanup_cutoff(_decided(v), latest, NOW).select("server_id", "policy_id", "database_id", "cleanup_before")


_INSTANCE = "server_name || CASE WHEN instance_name IS NULL THEN '' ELSE '$' || instance_name END"
_GROUP = "CASE WHEN cluster_name IS NULL THEN '' ELSE cluster_name || '$' END || availability_group"
_HOME = f"CASE WHEN availability_group IS NULL THEN {_INSTANCE} ELSE {_GROUP} END"
_FS = "rtrim(regexp_replace(name, '[\\\\/:*?\"<>|]', '', 'g'))"
_PLAN_SQL = _SIZED_SQL + ", " + _LATEST_SQL + f""",
plan AS (
  SELECT s.*, {_SKIP_SQL} AS skip_reason, {_CUTOFF} AS cleanup_before, {_FS} AS fs,
         row_number() OVER (PARTITION BY s.server_id, policy_id ORDER BY start_position NULLS FIRST, name) AS plan_order,
         {_HOME} || chr(92) || {_FS} || chr(92) || kind || CASE WHEN copy_only THEN '_COPY_ONLY' ELSE '' END AS directory,
         {_HOME} || '_{{DatabaseName}}_' || kind || CASE WHEN copy_only THEN '_COPY_ONLY' ELSE '' END || '_20240131_000000' || CASE WHEN file_count = 1 THEN '' ELSE '_{{FileNumber}}' END
           || CASE kind WHEN 'LOG' THEN '.trn' ELSE '.bak' END AS file_template
  FROM sized s LEFT JOIN latest USING (server_id, name))
"""
_PLAN_COLUMNS = "server_id, policy_id, name, database_id, kind AS decided_backup_type, skip_reason, backup_bytes, file_count, cleanup_before, directory, file_template"


def _plan(v):
    return maintenance.backup_plan(v("fx_databases"), v("fx_policies"), v("fx_backups"), NOW)


@query("backup_plan", "WITH " + _PLAN_SQL + f"SELECT {_PLAN_COLUMNS} FROM plan")
def _(v):
    return _plan(v).select(
        "server_id", "policy_id", "name", "database_id", "decided_backup_type", "skip_reason", "backup_bytes", "file_count",
        "cleanup_before", "directory", "file_template",
    )


_GROUPED_SQL = """
WITH names AS (SELECT * FROM fx_databases WHERE lower(name) NOT IN ('tempdb', 'master') AND source_database_id IS NULL),
picked AS (
  SELECT n.server_id, p.policy_id, n.name, n.database_id, n.availability_group, {fs} AS fs,
         CASE p.policy_id WHEN 0 THEN availability_group IS NOT NULL AND NOT availability_group LIKE '%b'
                          WHEN 1 THEN availability_group IN ('group1a', 'group2b') ELSE lower(name) LIKE 'customer#00000000%' END AS selected,
         CASE p.policy_id WHEN 0 THEN 1 WHEN 1 THEN CASE availability_group WHEN 'group2b' THEN 1 WHEN 'group1a' THEN 2 END ELSE 1 END AS start_position
  FROM names n JOIN fx_policies p USING (server_id) WHERE p.policy_id < 3),
clashes AS (SELECT server_id, policy_id, upper(fs) AS k FROM picked WHERE fs <> '' GROUP BY ALL HAVING count(*) > 1 AND bool_or(selected)),
absent AS (
  SELECT p.server_id, p.policy_id,
         CASE WHEN p.policy_id = 1 THEN (
           SELECT string_agg('[' || w.name || ']', ', ' ORDER BY w.position) FROM (VALUES ('group2b', 1), ('group1a', 2), ('nobody', 3)) w(name, position)
           WHERE NOT EXISTS (SELECT 1 FROM fx_database_groups g WHERE g.server_id = p.server_id AND lower(g.name) = w.name)) END AS missing_names
  FROM fx_policies p)
SELECT c.server_id, c.policy_id, c.name, c.database_id, c.availability_group, k.k IS NOT NULL AS is_ambiguous, a.missing_names,
       row_number() OVER (PARTITION BY c.server_id, c.policy_id ORDER BY start_position NULLS FIRST, c.name, c.database_id) AS plan_order
FROM picked c LEFT JOIN clashes k ON k.server_id = c.server_id AND k.policy_id = c.policy_id AND k.k = upper(c.fs) AND c.fs <> ''
LEFT JOIN absent a ON a.server_id = c.server_id AND a.policy_id = c.policy_id
WHERE selected
"""


@query("backup_plan_groups", _GROUPED_SQL.replace("{fs}", _FS).replace("ORDER BY start_position NULLS FIRST, c.name, c.database_id", "ORDER BY start_position NULLS FIRST, c.name"))
def _(v):
    at = F.col("policy_id")
    policies = v("fx_policies").filter("policy_id < 3").withColumns({
        "group_spec": F.when(at == 0, "ALL_AVAILABILITY_GROUPS,-%b").when(at == 1, "group2b, group1a,nobody"),
        "spec": F.when(at == 2, "customer#00000000%"),
    })
    # Databases of one name would tie in the order.
    rows = maintenance.backup_plan(v("fx_databases").filter("lower(name) <> 'master'"), policies, v("fx_backups"), NOW, groups=v("fx_database_groups"))
    return rows.select(
        "server_id", "policy_id", "name", "database_id", "availability_group", "is_ambiguous", "missing_names", F.col("plan_order").cast("bigint").alias("plan_order")
    )


def _targets(v):
    # Each policy has directories of its own; the log backups of policy 1 are mirrored.
    places = F.explode(F.sequence(F.lit(1), F.col("directory_count"))).alias("position")
    rows = v("fx_policies").select("server_id", "policy_id", places)
    mirrors = F.when(F.col("policy_id") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("mirror", F.explode(mirrors))
    drive = F.when(F.col("mirror") == 0, "E:\\policy").otherwise("M:\\policy")
    path = F.concat(drive, F.col("policy_id").cast("string"), F.lit("\\backup"), F.col("position").cast("string"))
    return backup_rules.number_targets(rows.withColumn("path", path))


_TARGETS_SQL = """
targets AS (
  SELECT server_id, policy_id, m AS mirror, p AS position, CASE m WHEN 0 THEN 'E:' ELSE 'M:' END || chr(92) || 'policy' || CAST(policy_id AS STRING) || chr(92) || 'backup' || CAST(p AS STRING) AS path,
         row_number() OVER (PARTITION BY server_id, policy_id, m ORDER BY p) AS directory_no
  FROM fx_policies, range(1, 65) t(p), range(0, 2) u(m) WHERE p <= directory_count AND (m = 0 OR policy_id = 1))
"""


@query("stripe_number", "WITH " + _TARGETS_SQL + "SELECT * FROM targets")
def _(v):
    return _targets(v).withColumns({c: F.col(c).cast("bigint") for c in ("mirror", "position", "directory_no")})


_FILES_SQL = _PLAN_SQL + "," + _TARGETS_SQL + """,
numbered AS (
  SELECT p.*, f.n AS file_number, (f.n - 1) // greatest((file_count + directory_count - 1) // directory_count, 1) + 1 AS directory_no,
         CASE WHEN file_count <= 9 THEN CAST(f.n AS STRING) ELSE lpad(CAST(f.n AS STRING), 2, '0') END AS number_text
  FROM plan p, LATERAL (SELECT unnest(range(1, p.file_count + 1)) AS n) f WHERE skip_reason IS NULL)
"""


@query("backup_files", "WITH " + _FILES_SQL + """
SELECT server_id, policy_id, database_id, file_number, directory_no, mirror,
       path || chr(92) || directory || chr(92) || replace(replace(file_template, '{DatabaseName}', fs), '{FileNumber}', number_text) AS file_path
FROM numbered LEFT JOIN targets USING (server_id, policy_id, directory_no)
""")
def _(v):
    files = maintenance.backup_files(_plan(v), _targets(v))
    return files.select("server_id", "policy_id", "database_id", "file_number", F.col("directory_no").cast("bigint").alias("directory_no"), F.col("mirror").cast("bigint").alias("mirror"), "file_path")


def _templated(v):
    """Policies 0 and 1 with templates of their own, the rest with the usual ones."""
    policies, at = v("fx_policies"), F.col("policy_id")
    databases = v("fx_databases").withColumns({"major_version": (F.col("database_id") % 4 + 13).cast("string"), "minor_version": F.lit("2")})
    own = {
        "directory_structure": F.when(at == 0, "{DatabaseName}/{BackupType}_{Partial}_{CopyOnly}/v{MajorVersion}.{MinorVersion}").when(at == 1, ""),
        "group_directory_structure": F.when(at == 0, "{AvailabilityGroupName}-{ClusterName}{DirectorySeparator}{DatabaseName}").when(at == 1, ""),
        "file_name_structure": F.when(at == 1, "{DatabaseName}_{BackupType}_{Year}-{Month}-{Day}_{FileNumber}of{NumberOfFiles}.{FileExtension}"),
        "group_file_name_structure": F.when(at == 1, "{AvailabilityGroupName}_{DatabaseName}_{Hour}{Minute}_{FileNumber}.{FileExtension}"),
    }
    return maintenance.backup_plan(databases, policies.withColumns(own), v("fx_backups"), NOW)


@query("backup_templates", "WITH " + _PLAN_SQL + """
SELECT server_id, policy_id, database_id,
       CASE WHEN policy_id = 1 THEN ''
            WHEN policy_id = 0 AND availability_group IS NOT NULL THEN availability_group || CASE WHEN cluster_name IS NULL THEN '' ELSE '-' || cluster_name END || chr(92) || fs
            WHEN policy_id = 0 THEN fs || chr(92) || kind || CASE WHEN copy_only THEN '_COPY_ONLY' ELSE '' END || chr(92) || 'v' || CAST(database_id % 4 + 13 AS STRING) || '.2'
            ELSE directory END AS directory,
       CASE WHEN policy_id = 1 AND availability_group IS NOT NULL THEN availability_group || '_{DatabaseName}_0000' || CASE WHEN file_count = 1 THEN '' ELSE '_{FileNumber}' END || CASE kind WHEN 'LOG' THEN '.trn' ELSE '.bak' END
            WHEN policy_id = 1 THEN '{DatabaseName}_' || kind || '_2024-01-31' || CASE WHEN file_count = 1 THEN '' ELSE '_{FileNumber}of' || CAST(file_count AS STRING) END || CASE kind WHEN 'LOG' THEN '.trn' ELSE '.bak' END
            ELSE file_template END AS file_template
FROM plan
""")
def _(v):
    return _templated(v).select("server_id", "policy_id", "database_id", "directory", "file_template")


# ---- integrity checks and commands ---------------------------------------------------

_CHECK_SQL = _SELECTION_SQL + """,
last_ok AS (SELECT server_id, database_name AS name, max(start_time) AS last_command_time FROM fx_commands WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0 GROUP BY ALL),
eligible AS (
  SELECT r.*, l.last_command_time, CASE
    WHEN state NOT IN ('ONLINE', 'EMERGENCY') THEN 'not online'
    WHEN user_access = 'SINGLE_USER' AND NOT is_accessible THEN 'single user and not accessible'
    WHEN replica_role IS NOT NULL AND replica_role <> 'PRIMARY' AND NOT checks_secondaries THEN 'edition checks the primary only'
    WHEN NOT (replica_role IS NULL OR replica_scope = 'ALL' OR (replica_scope = 'PRIMARY' AND replica_role = 'PRIMARY') OR (replica_scope = 'SECONDARY' AND replica_role = 'SECONDARY')
              OR (replica_scope = 'PREFERRED_BACKUP_REPLICA' AND coalesce(is_preferred_replica, FALSE))) THEN 'other replica role wanted'
    WHEN is_read_only AND updateability = 'READ_WRITE' THEN 'read-only database' END AS skip_reason
  FROM resolved r LEFT JOIN last_ok l USING (server_id, name) WHERE selected),
allowed AS (SELECT *, skip_reason IS NULL AND (replica_role IS NULL OR replica_role = 'PRIMARY') AS may_check_objects FROM eligible)
"""


@query("last_success", """
SELECT server_id, database_name, max(start_time) AS last_command_time FROM fx_commands WHERE command_type = 'DBCC_CHECKDB' AND error_number = 0 GROUP BY ALL
""")
def _(v):
    return checks.last_success(v("fx_commands"), "DBCC_CHECKDB")


@query("integrity_check_eligibility", "WITH " + _CHECK_SQL + "SELECT server_id, policy_id, database_id, skip_reason, may_check_objects FROM allowed")
def _(v):
    rows = checks.integrity_check_eligibility(_resolved(v).filter("selected"))
    return rows.select("server_id", "policy_id", "database_id", "skip_reason", "may_check_objects")


@query("integrity_plan", "WITH " + _CHECK_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY server_id, policy_id ORDER BY last_command_time NULLS FIRST, name) AS plan_order FROM allowed),
commands AS (SELECT r.*, trim(c.command) AS check_command FROM ranked r, LATERAL (SELECT unnest(string_split(r.check_commands, ',')) AS command) c)
SELECT server_id, policy_id, name, last_command_time, skip_reason, check_command FROM commands
WHERE check_command <> 'CHECKTABLE' OR may_check_objects
""")
def _(v):
    rows = maintenance.integrity_plan(v("fx_databases"), v("fx_policies"), v("fx_commands"), "REPLICA_LAST_GOOD_CHECK_ASC")
    return rows.select("server_id", "policy_id", "name", "last_command_time", "skip_reason", "check_command")


@query("integrity_targets", "WITH " + _CHECK_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY server_id, policy_id ORDER BY start_position NULLS FIRST, name) AS plan_order FROM allowed),
commands AS (
  SELECT r.*, c.check_command FROM ranked r,
  LATERAL (SELECT unnest(CASE WHEN policy_id % 2 = 0 THEN ['CHECKFILEGROUP', 'CHECKCATALOG'] ELSE ['CHECKTABLE', 'CHECKALLOC'] END) AS check_command) c
  WHERE c.check_command <> 'CHECKTABLE' OR may_check_objects),
targets AS (
  SELECT c.*, NULL AS filegroup_name, NULL AS schema_name, NULL AS object_name, NULL AS position FROM commands c
  WHERE check_command NOT IN ('CHECKFILEGROUP', 'CHECKTABLE') OR skip_reason IS NOT NULL
  UNION ALL
  SELECT c.*, f.filegroup_name, NULL, NULL, CASE WHEN policy_id = 2 THEN CASE WHEN f.filegroup_name = 'PRIMARY' THEN 2 ELSE 1 END WHEN policy_id = 0 THEN 1 END
  FROM commands c JOIN fx_db_filegroups f ON f.server_id = c.server_id AND f.database_name = c.name
  WHERE check_command = 'CHECKFILEGROUP' AND skip_reason IS NULL AND CASE policy_id WHEN 0 THEN f.filegroup_name <> 'FG1' ELSE TRUE END
  UNION ALL
  SELECT c.*, NULL, o.schema_name, o.object_name, CASE WHEN policy_id = 1 THEN CASE WHEN o.schema_name = 'dbo' THEN 1 ELSE 2 END END
  FROM commands c JOIN fx_db_objects o ON o.server_id = c.server_id AND o.database_name = c.name
  WHERE check_command = 'CHECKTABLE' AND skip_reason IS NULL AND (policy_id <> 1 OR NOT starts_with(o.object_name, 't2_')))
SELECT server_id, policy_id, name, check_command, skip_reason, filegroup_name, schema_name, object_name,
       row_number() OVER (PARTITION BY server_id, policy_id ORDER BY plan_order, check_command, position NULLS FIRST, filegroup_name NULLS FIRST, schema_name NULLS FIRST, object_name NULLS FIRST) AS target_order
FROM targets
""")
def _(v):
    at = F.col("policy_id")
    policies = v("fx_policies").withColumns({
        "check_commands": F.when(at % 2 == 0, "CHECKFILEGROUP,CHECKCATALOG").otherwise("CHECKTABLE,CHECKALLOC"),
        "filegroup_spec": F.when(at == 0, "ALL_FILEGROUPS,-%.FG1").when(at == 2, "%.FG%,%.PRIMARY"),
        "object_spec": F.when(at == 1, "%.dbo.%,%.app.orders,-%.%.t2_%"),
    })
    plan = maintenance.integrity_plan(v("fx_databases"), policies, v("fx_commands"))
    rows = maintenance.integrity_targets(plan, policies, v("fx_db_filegroups"), v("fx_db_objects"))
    return rows.select("server_id", "policy_id", "name", "check_command", "skip_reason", "filegroup_name", "schema_name", "object_name", F.col("target_order").cast("bigint").alias("target_order"))


_OUTCOME_SQL = """
outcomes AS (
  SELECT *, CASE WHEN error_number IS NULL THEN 'Not Executed' WHEN error_number = 0 THEN 'Succeeded' ELSE 'Failed' END AS outcome,
         date_diff('second', start_time, end_time) AS duration_seconds FROM fx_commands)
"""


@query("command_outcomes", "WITH " + _OUTCOME_SQL + """
SELECT server_id, database_name, command_type, start_time, outcome, duration_seconds,
       CASE WHEN duration_seconds // 86400 > 0 THEN CAST(duration_seconds // 86400 AS STRING) || '.' ELSE '' END
         || lpad(CAST(duration_seconds % 86400 // 3600 AS STRING), 2, '0') || ':' || lpad(CAST(duration_seconds % 3600 // 60 AS STRING), 2, '0') || ':' || lpad(CAST(duration_seconds % 60 AS STRING), 2, '0') AS duration,
       CAST(CASE WHEN error_number = 1205 THEN 10 WHEN error_number > 0 THEN 16 END AS INT) AS severity,
       CASE WHEN error_number = 1205 THEN 0 ELSE coalesce(error_number, 0) END AS return_code
FROM outcomes
""")
def _(v):
    rows = checks.command_outcomes(v("fx_commands"), lock_message_severity=10)
    return rows.select("server_id", "database_name", "command_type", "start_time", "outcome", "duration_seconds", "duration", "severity", "return_code")


@query("command_report", "WITH " + _OUTCOME_SQL + """
SELECT server_id, database_name, command_type, count(*) AS commands, count(*) FILTER (outcome = 'Succeeded') AS succeeded, count(*) FILTER (outcome = 'Failed') AS failed,
       count(*) FILTER (outcome = 'Not Executed') AS not_executed, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds, max(start_time) FILTER (outcome = 'Succeeded') AS last_success
FROM outcomes GROUP BY ALL
""")
def _(v):
    return maintenance.command_report(v("fx_commands"))


# ---- indexes and statistics ----------------------------------------------------------

_FRAG_SQL = """
frag AS (SELECT server_id, database_name, object_id, index_id, partition_number, max(fragmentation) AS fragmentation, CAST(sum(page_count) AS BIGINT) AS page_count
         FROM fx_index_physical WHERE alloc_unit_type = 'IN_ROW_DATA' AND index_level = 0 GROUP BY ALL),
every_frag AS (SELECT * FROM frag UNION ALL
  SELECT server_id, database_name, object_id, index_id, NULL, max(fragmentation), CAST(sum(page_count) AS BIGINT) FROM frag GROUP BY ALL),
counts AS (SELECT server_id, database_name, object_id, index_id, count(DISTINCT partition_number) AS partition_count FROM fx_indexes GROUP BY ALL),
policies AS (
  SELECT * REPLACE (coalesce(fragmentation_low, CASE WHEN policy_id < 2 THEN NULL END) AS fragmentation_low) FROM fx_index_policies)
"""
_ALLOWED = {
    "INDEX_REORGANIZE": "writable AND disk AND index_type <= 5 AND (allow_page_locks OR index_type = 5)",
    "INDEX_REBUILD_ONLINE": "writable AND disk AND ((index_type = 1 AND NOT is_image_text AND (NOT is_new_lob OR NOT is_file_stream)) OR index_type = 2) AND NOT is_column_store",
    "INDEX_REBUILD_OFFLINE": "writable AND disk AND index_type <= 5",
}


def _pick(actions: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_ALLOWED[a]} THEN '{a}'" for a in actions) + " END"


_R, _N, _O = "INDEX_REORGANIZE", "INDEX_REBUILD_ONLINE", "INDEX_REBUILD_OFFLINE"
_INDEX_SQL = _FRAG_SQL + f""",
matched AS (
  SELECT i.*, p.* EXCLUDE (server_id), CASE
    WHEN policy_id = 0 THEN i.database_name <> 'db1'
    WHEN policy_id = 1 THEN ((i.database_name = 'db0' AND i.schema_name = 'schema1' AND i.object_name LIKE 'part%' AND i.index_name = 'ix_2')
                          OR (i.database_name = 'db2' AND i.schema_name = 'schema0' AND i.object_name LIKE 'part1%')) AND NOT i.object_name LIKE '%9'
    ELSE TRUE END AS selected,
    CASE WHEN policy_id = 0 THEN 1 WHEN policy_id = 1 THEN CASE WHEN i.database_name = 'db0' THEN 1 ELSE 2 END END AS start_position
  FROM fx_indexes i JOIN policies p USING (server_id)),
measured AS (
  SELECT m.*, c.partition_count, f.fragmentation, f.page_count, s.row_count, s.modification_counter,
         NOT on_read_only_filegroup AS writable, NOT is_memory_optimized AS disk,
         CASE WHEN f.fragmentation >= 30 THEN 'High' WHEN f.fragmentation >= 5 THEN 'Medium' WHEN f.fragmentation < 5 THEN 'Low' END AS fragmentation_group
  FROM matched m
  LEFT JOIN counts c ON c.server_id = m.server_id AND c.database_name = m.database_name AND c.object_id = m.object_id AND c.index_id = m.index_id
  LEFT JOIN every_frag f ON f.server_id = m.server_id AND f.database_name = m.database_name AND f.object_id = m.object_id AND f.index_id = m.index_id AND f.partition_number IS NOT DISTINCT FROM m.partition_number
  LEFT JOIN fx_stats_props s ON s.server_id = m.server_id AND s.database_name = m.database_name AND s.object_id = m.object_id AND s.statistics_id = m.statistics_id
  WHERE m.selected),
acted AS (
  SELECT *, CASE WHEN resumable THEN '{_N}' WHEN page_count >= 1000 THEN CASE
      WHEN fragmentation_group = 'High' THEN CASE WHEN policy_id = 2 THEN {_pick([_R])} ELSE {_pick([_N, _O])} END
      WHEN fragmentation_group = 'Medium' THEN CASE policy_id WHEN 0 THEN {_pick([_R, _N, _O])} WHEN 1 THEN {_pick([_N, _R])} ELSE {_pick([_R])} END
      WHEN fragmentation_group = 'Low' THEN CASE WHEN policy_id = 2 THEN {_pick([_R])} END END
    WHEN policy_id = 2 AND page_count >= 1000 THEN {_pick([_R])} END AS action
  FROM measured),
updated AS (
  SELECT *, coalesce(((update_statistics = 'ALL' AND index_type IN (1, 2, 3, 4, 7)) OR (update_statistics = 'INDEX' AND index_type IN (1, 2, 3, 4, 7)))
    AND ((NOT only_modified_statistics AND statistics_modification_level IS NULL) OR (only_modified_statistics AND coalesce(modification_counter, 0) > 0))
    AND ((coalesce(partition_count, 0) = 1 AND coalesce(action, '') NOT IN ('{_N}', '{_O}')) OR (partition_number IS NULL AND coalesce(action, '') NOT IN ('{_N}', '{_O}')) OR (partition_count <> 1 AND partition_number = partition_count)), FALSE) AS update_statistics_now
  FROM acted)
"""


@query("index_fragmentation", "WITH " + _FRAG_SQL + "SELECT * FROM frag")
def _(v):
    return index_rules.index_fragmentation(v("fx_index_physical"))


@query("partition_counts", "WITH " + _FRAG_SQL + "SELECT * FROM counts")
def _(v):
    return index_rules.partition_counts(v("fx_indexes"))


@query("fragmentation_group", "WITH " + _FRAG_SQL + """
SELECT server_id, database_name, object_id, index_id, partition_number, CASE WHEN fragmentation >= 30 THEN 'High' WHEN fragmentation >= 5 THEN 'Medium' ELSE 'Low' END AS fragmentation_group FROM frag
""")
def _(v):
    rows = index_rules.index_fragmentation(v("fx_index_physical")).withColumns({"fragmentation_level1": F.lit(5), "fragmentation_level2": F.lit(30)})
    return index_rules.fragmentation_group(rows).select("server_id", "database_name", "object_id", "index_id", "partition_number", "fragmentation_group")


@query("allowed_actions", """
WITH flags AS (SELECT *, NOT on_read_only_filegroup AS writable, NOT is_memory_optimized AS disk FROM fx_indexes)
""" + " UNION ALL ".join(
    f"SELECT server_id, object_id, index_id, partition_number, '{a}' AS action FROM flags WHERE {test}" for a, test in _ALLOWED.items()
))
def _(v):
    counts = index_rules.partition_counts(v("fx_indexes"))
    rows = v("fx_indexes").join(counts, ["server_id", "database_name", "object_id", "index_id"], "left")
    rows = rows.withColumns({"major_version": F.lit(16), "online_capable": F.lit(True)})
    return index_rules.allowed_actions(rows).select("server_id", "object_id", "index_id", "partition_number", "action")


@query("action_priority", """
WITH lists AS (
  SELECT server_id * 10 + policy_id AS policy_id, 'Low' AS fragmentation_group, fragmentation_low AS l FROM fx_index_policies
  UNION ALL SELECT server_id * 10 + policy_id, 'Medium', fragmentation_medium FROM fx_index_policies
  UNION ALL SELECT server_id * 10 + policy_id, 'High', fragmentation_high FROM fx_index_policies)
SELECT policy_id, fragmentation_group, u.priority, trim(u.action) AS action
FROM lists, LATERAL (SELECT unnest(string_split(l, ',')) AS action, unnest(range(1, len(string_split(l, ',')) + 1)) AS priority) u WHERE l IS NOT NULL
""")
def _(v):
    policies = v("fx_index_policies").withColumn("policy_id", F.col("server_id") * 10 + F.col("policy_id"))
    return index_rules.action_priority(policies).withColumn("priority", F.col("priority").cast("bigint"))


@query("uniform_actions", "SELECT server_id * 10 + policy_id AS policy_id, policy_id = 2 AND fragmentation_high = fragmentation_low AS is_uniform FROM fx_index_policies")
def _(v):
    policies = v("fx_index_policies").withColumn("policy_id", F.col("server_id") * 10 + F.col("policy_id"))
    return index_rules.uniform_actions(index_rules.action_priority(policies))


def _index_inputs(v):
    return v("fx_indexes"), v("fx_index_policies"), v("fx_index_physical"), v("fx_stats_props")


@query("index_action", "WITH " + _INDEX_SQL + "SELECT server_id, policy_id, object_id, index_id, partition_number, fragmentation_group, action FROM acted")
def _(v):
    return maintenance.index_decisions(*_index_inputs(v)).select("server_id", "policy_id", "object_id", "index_id", "partition_number", "fragmentation_group", "action")


@query("statistics_decision", "WITH " + _INDEX_SQL + "SELECT server_id, policy_id, object_id, index_id, partition_number, update_statistics_now FROM updated")
def _(v):
    return maintenance.index_decisions(*_index_inputs(v)).select("server_id", "policy_id", "object_id", "index_id", "partition_number", "update_statistics_now")


@query("index_plan", "WITH " + _INDEX_SQL + """
SELECT server_id, policy_id, database_name, object_name, index_name, partition_number, action, update_statistics_now,
       row_number() OVER (PARTITION BY server_id, policy_id ORDER BY resumable DESC, start_position NULLS FIRST, database_name, schema_name, object_name, index_type, index_name, partition_number) AS plan_order
FROM updated
""")
def _(v):
    return maintenance.index_plan(*_index_inputs(v)).select(
        "server_id", "policy_id", "database_name", "object_name", "index_name", "partition_number", "action", "update_statistics_now",
        F.col("plan_order").cast("bigint").alias("plan_order"),
    )


_STATISTICS_SQL = _FRAG_SQL.replace(""",
policies AS (
  SELECT * REPLACE (coalesce(fragmentation_low, CASE WHEN policy_id < 2 THEN NULL END) AS fragmentation_low) FROM fx_index_policies)
""", "") + f""",
stacked AS (
  SELECT DISTINCT server_id, database_name, schema_name, object_name, object_id, index_id, index_name, index_type, allow_page_locks, is_image_text, is_new_lob, is_file_stream,
         is_column_store, is_memory_optimized, on_read_only_filegroup, resumable, statistics_id, statistics_name, is_incremental, partition_number
  FROM fx_indexes
  UNION ALL
  SELECT DISTINCT server_id, database_name, schema_name, object_name, object_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, is_memory_optimized, NULL, NULL,
         statistics_id, statistics_name, is_incremental, NULL
  FROM fx_column_statistics c
  WHERE NOT EXISTS (SELECT 1 FROM fx_indexes i WHERE i.server_id = c.server_id AND i.database_name = c.database_name AND i.object_id = c.object_id AND i.index_id = c.statistics_id)),
matched AS (
  SELECT s.*, p.* EXCLUDE (server_id, spec),
         CASE policy_id WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN database_name = 'db1' AND schema_name = 'schema1' THEN 1 ELSE 2 END END AS start_position
  FROM stacked s JOIN fx_statistics_policies p USING (server_id)
  WHERE policy_id = 0 OR (policy_id = 1 AND coalesce(index_name, statistics_name) <> 'st_9')
     OR (policy_id = 2 AND ((database_name = 'db1' AND schema_name = 'schema1') OR (database_name = 'db2' AND object_name LIKE 'part1%' AND starts_with(coalesce(index_name, statistics_name), 'st_1'))))),
spread AS (
  SELECT m.* REPLACE (CASE WHEN m.index_id IS NULL AND partition_level_statistics THEN q.partition_number ELSE m.partition_number END AS partition_number)
  FROM matched m LEFT JOIN (SELECT DISTINCT server_id, database_name, object_id, statistics_id, partition_number FROM fx_incremental_props) q
    ON m.index_id IS NULL AND partition_level_statistics AND q.server_id = m.server_id AND q.database_name = m.database_name AND q.object_id = m.object_id AND q.statistics_id = m.statistics_id),
measured AS (
  SELECT m.*, c.partition_count, f.page_count, NOT on_read_only_filegroup AS writable, NOT is_memory_optimized AS disk,
         CASE WHEN f.fragmentation >= 30 THEN 'High' WHEN f.fragmentation >= 5 THEN 'Medium' WHEN f.fragmentation < 5 THEN 'Low' END AS fragmentation_group,
         CASE WHEN partition_level_statistics AND is_incremental THEN q.row_count ELSE s.row_count END AS row_count,
         CASE WHEN partition_level_statistics AND is_incremental THEN q.modification_counter ELSE s.modification_counter END AS modification_counter
  FROM spread m
  LEFT JOIN counts c ON c.server_id = m.server_id AND c.database_name = m.database_name AND c.object_id = m.object_id AND c.index_id = m.index_id
  LEFT JOIN every_frag f ON f.server_id = m.server_id AND f.database_name = m.database_name AND f.object_id = m.object_id AND f.index_id = m.index_id AND f.partition_number IS NOT DISTINCT FROM m.partition_number
  LEFT JOIN fx_stats_props s ON s.server_id = m.server_id AND s.database_name = m.database_name AND s.object_id = m.object_id AND s.statistics_id = m.statistics_id
  LEFT JOIN fx_incremental_props q ON q.server_id = m.server_id AND q.database_name = m.database_name AND q.object_id = m.object_id AND q.statistics_id = m.statistics_id AND q.partition_number = m.partition_number),
acted AS (
  SELECT *, CASE WHEN resumable THEN '{_N}' WHEN page_count >= 1000 THEN CASE fragmentation_group WHEN 'High' THEN {_pick([_N, _O])} WHEN 'Medium' THEN {_pick([_R, _N, _O])} END END AS action
  FROM measured),
updated AS (
  SELECT *, coalesce(
      CASE update_statistics WHEN 'ALL' THEN index_id IS NULL OR index_type IN (1, 2, 3, 4, 7) ELSE index_id IS NULL END
      AND CASE policy_id WHEN 0 THEN TRUE WHEN 2 THEN coalesce(modification_counter, 0) > 0
          ELSE coalesce(modification_counter * 100 >= 3 * nullif(row_count, 0), FALSE) OR (coalesce(modification_counter, 0) > 0 AND modification_counter >= sqrt(row_count * 1000)) END
      AND CASE WHEN partition_number IS NULL OR partition_count = 1 THEN coalesce(action, '') NOT IN ('{_N}', '{_O}')
          ELSE coalesce(partition_number = partition_count, FALSE) OR (partition_level_statistics AND is_incremental) END, FALSE) AS update_statistics_now
  FROM acted)
"""


def _statistics_inputs(v):
    # All is grouped and joined by part, so both tables are dealt by it once.
    v = v.dealt(
        lineitem=["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"], part=["p_partkey", "p_size"]
    )
    return *(v(x) for x in ("fx_indexes", "fx_statistics_policies", "fx_index_physical", "fx_stats_props", "fx_column_statistics", "fx_incremental_props")),


@query("statistics_by_partition", "WITH " + _STATISTICS_SQL + """
SELECT server_id, policy_id, object_id, index_id, statistics_id, partition_number, row_count, modification_counter, update_statistics_now FROM updated
""")
def _(v):
    return maintenance.index_decisions(*_statistics_inputs(v)).select(
        "server_id", "policy_id", "object_id", "index_id", "statistics_id", "partition_number", "row_count", "modification_counter", "update_statistics_now"
    )


@query("index_plan_statistics", "WITH " + _STATISTICS_SQL + """
SELECT server_id, policy_id, database_name, object_name, index_name, statistics_name, partition_number, action, update_statistics_now,
       row_number() OVER (PARTITION BY server_id, policy_id ORDER BY resumable DESC NULLS LAST, start_position NULLS FIRST, database_name, schema_name, object_name,
                          index_type IS NULL, index_type, index_name, statistics_name, partition_number NULLS FIRST) AS plan_order
FROM updated
""")
def _(v):
    wanted = [
        "server_id", "policy_id", "database_name", "object_name", "index_name", "statistics_name", "partition_number", "action", "update_statistics_now", "plan_order",
    ]
    rows = maintenance.index_plan(*_statistics_inputs(v), columns=wanted, by_object=True)
    return rows.withColumn("plan_order", F.col("plan_order").cast("bigint"))


@query("index_and_statistics", """
SELECT server_id, database_name, object_id, index_id, statistics_id, statistics_name FROM (SELECT DISTINCT server_id, database_name, object_id, index_id, statistics_id, statistics_name FROM fx_indexes)
UNION
SELECT c.server_id, c.database_name, c.object_id, NULL, c.statistics_id, c.statistics_name FROM fx_column_stats c
WHERE NOT EXISTS (SELECT 1 FROM fx_indexes i WHERE i.server_id = c.server_id AND i.database_name = c.database_name AND i.object_id = c.object_id AND i.index_id = c.statistics_id)
""")
def _(v):
    columns = ["server_id", "database_name", "object_id", "index_id", "statistics_id", "statistics_name"]
    return index_rules.index_and_statistics(v("fx_indexes").select(*columns), v("fx_column_stats")).select(*columns)
