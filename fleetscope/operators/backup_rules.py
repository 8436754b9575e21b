"""Backup decisions, evaluated as columns over a fleet inventory.

A row is one database under one policy. Database columns: ``name, state, user_access,
is_accessible, in_standby, recovery_model, is_read_only, log_lsn, differential_base_lsn,
differential_base_is_snapshot, allocated_pages, modified_pages, database_pages, log_size_mb,
last_log_backup, availability_group, replica_role, is_preferred_replica, log_shipping_role``.
Policy columns are named in ``POLICY_DEFAULTS``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import templates
from fleetscope.functions.semantics import add_ms, boundaries_between, int_div
from fleetscope.operators.ranking import number_rows

POLICY_DEFAULTS: dict[str, tuple[str, object]] = {
    "backup_type": ("string", "FULL"),
    "change_backup_type": ("boolean", False),
    "modification_level": ("int", None),
    "copy_only": ("boolean", False),
    "override_backup_preference": ("boolean", False),
    "exclude_log_shipped": ("boolean", True),
    "updateability": ("string", "ALL"),
    "log_size_threshold_mb": ("int", None),
    "log_time_threshold_s": ("int", None),
    "backup_software": ("string", None),
    "directory_count": ("int", 1),
    "number_of_files": ("int", None),
    "min_size_for_multiple_mb": ("bigint", None),
    "max_file_size_mb": ("bigint", None),
    "cleanup_hours": ("int", None),
    "read_write_filegroups": ("boolean", False),
}


def with_policy_defaults(policies: DataFrame) -> DataFrame:
    """Add policy columns that are not given."""
    missing = {
        name: F.lit(value).cast(kind) for name, (kind, value) in POLICY_DEFAULTS.items() if name not in policies.columns
    }
    return policies.withColumns(missing) if missing else policies


def backup_type_decision(databases: DataFrame) -> DataFrame:
    """Backup type after escalation: log to differential, then differential to full."""
    c = F.col
    escalate, master = c("change_backup_type"), F.lower("name") == "master"
    log_impossible = c("recovery_model").isin("FULL", "BULK_LOGGED") & c("log_lsn").isNull() & ~master
    first = F.when(escalate & (c("backup_type") == "LOG") & log_impossible, "DIFF").otherwise(c("backup_type"))
    pages = F.nullif(c("allocated_pages"), F.lit(0))
    ratio = c("modified_pages").cast("decimal(19,0)") / pages.cast("decimal(19,0)") * 100
    diff_useless = master | c("differential_base_lsn").isNull() | F.coalesce(ratio >= c("modification_level"), F.lit(False))
    second = F.when(escalate & (first == "DIFF") & diff_useless, "FULL").otherwise(first)
    snapshot = F.coalesce(c("differential_base_is_snapshot"), F.lit(False))
    return databases.withColumn(
        "decided_backup_type", F.when(escalate & (second == "DIFF") & snapshot, "FULL").otherwise(second)
    )


def _backup_blockers(now: datetime) -> dict[str, Column]:
    """Reasons against a backup, in the order they are checked."""
    c, kind = F.col, F.col("decided_backup_type")
    grouped = c("availability_group").isNotNull()
    not_primary = (c("replica_role") != "PRIMARY") | c("replica_role").isNull()
    not_preferred = (~c("is_preferred_replica") | c("is_preferred_replica").isNull()) & ~c("override_backup_preference")
    master = F.lower("name") == "master"
    waited = boundaries_between("second", c("last_log_backup"), F.lit(now))
    due = (
        (c("log_size_mb") >= c("log_size_threshold_mb")) | c("log_size_mb").isNull()
        | (waited >= c("log_time_threshold_s")) | c("last_log_backup").isNull()
    )
    return {
        "not online": c("state") != "ONLINE",
        "single user and not accessible": (c("user_access") == "SINGLE_USER") & ~c("is_accessible"),
        "in standby": c("in_standby"),
        "log backup in simple recovery": (kind == "LOG") & (c("recovery_model") == "SIMPLE"),
        "no log backup chain": (kind == "LOG") & c("recovery_model").isin("FULL", "BULK_LOGGED") & c("log_lsn").isNull(),
        "no differential base": (kind == "DIFF") & c("differential_base_lsn").isNull(),
        "master supports full backups only": kind.isin("DIFF", "LOG") & master,
        "full backup off the primary": grouped & (kind == "FULL") & ~c("copy_only") & not_primary,
        "copy-only full backup off the preferred replica": grouped & (kind == "FULL") & c("copy_only") & not_preferred,
        "differential backup off the primary": grouped & (kind == "DIFF") & not_primary,
        "log backup off the preferred replica": grouped & (kind == "LOG") & ~c("copy_only") & not_preferred,
        "copy-only log backup off the primary": grouped & (kind == "LOG") & c("copy_only") & not_primary,
        "log shipped": (F.coalesce(c("log_shipping_role"), F.lit("")) == "PRIMARY") & (kind == "LOG") & c("exclude_log_shipped"),
        "read-only database": c("is_read_only") & (c("updateability") == "READ_WRITE"),
        "read-write database": ~c("is_read_only") & (c("updateability") == "READ_ONLY"),
        "too little log for a log backup": (kind == "LOG") & c("log_size_threshold_mb").isNotNull()
        & c("log_time_threshold_s").isNotNull() & ~due,
        "log backup of read-only databases": (kind == "LOG") & (c("updateability") == "READ_ONLY")
        & (F.coalesce(c("backup_software"), F.lit("")) == "DATA_DOMAIN_BOOST"),
    }


def first_reason(blockers: dict[str, Column]) -> Column:
    """First reason that holds or cannot be decided; NULL where none does."""
    out = None
    for reason, blocked in blockers.items():
        test = F.coalesce(blocked, F.lit(True))
        out = F.when(test, F.lit(reason)) if out is None else out.when(test, F.lit(reason))
    return out


def backup_eligibility(decided: DataFrame, now: datetime) -> DataFrame:
    """Add ``skip_reason``, NULL where the database may be backed up.

    An unknown value that a check depends on counts against the backup.
    """
    return decided.withColumn("skip_reason", first_reason(_backup_blockers(now)))


def backup_file_count(decided: DataFrame) -> DataFrame:
    """Size in bytes and number of backup files."""
    c, kind = F.col, F.col("decided_backup_type")
    mb = F.lit(1024 * 1024).cast("bigint")
    size = (
        F.when(kind == "FULL", F.coalesce(c("allocated_pages"), c("database_pages")) * 8192)
        .when(kind == "DIFF", c("modified_pages") * 8192)
        .when(kind == "LOG", (c("log_size_mb") * mb).cast("bigint"))
    )
    out = decided.withColumn("backup_bytes", size)
    asked, folders, biggest = c("number_of_files"), c("directory_count"), c("max_file_size_mb") * mb
    least = c("min_size_for_multiple_mb") * mb
    software = F.coalesce(c("backup_software"), F.lit(""))
    cap = F.when(software.isin("SQLBACKUP", "DATA_DOMAIN_BOOST"), 32).otherwise(64)
    share = int_div(c("backup_bytes"), folders)
    needed = int_div(share, biggest) + F.when(share % biggest == 0, 0).otherwise(1)
    files = (
        F.when(asked.isNull() & (software == "DATA_DOMAIN_BOOST"), F.lit(1))
        .when(asked.isNull() & biggest.isNull(), folders)
        .when(asked == 1, asked)
        .when((asked > 1) & (least.isNull() | c("backup_bytes").isNull() | (c("backup_bytes") >= least)), asked)
        .when(asked > 1, folders)
        .when(c("backup_bytes").isNull() | (c("backup_bytes") == 0), folders)
        .otherwise(F.least(needed, int_div(cap, folders)) * folders)
    )
    return out.withColumn("file_count", files.cast("bigint"))


def latest_restorable_backup(backupset: DataFrame, databases: DataFrame) -> DataFrame:
    """Start of the newest undamaged backup a restore can begin from, per database.

    That is a full or differential backup, or a log backup older than the differential base.
    """
    base = databases.select("server_id", F.col("name").alias("database_name"), "differential_base_lsn").distinct()
    usable = F.col("type").isin("D", "I") | ((F.col("type") == "L") & (F.col("last_lsn") < F.col("differential_base_lsn")))
    return (
        backupset.filter("not is_damaged").join(base, ["server_id", "database_name"]).filter(usable)
        .groupBy("server_id", F.col("database_name").alias("name")).agg(F.max("backup_start_date").alias("latest_backup"))
    )


def cleanup_cutoff(decided: DataFrame, latest: DataFrame, now: datetime) -> DataFrame:
    """Time before which old backups may be deleted; NULL forbids any deletion.

    The cut is the earliest of now, now minus the cleanup hours and, for log backups,
    the latest restorable backup. One unknown candidate cancels the cleanup.
    """
    aged = add_ms(F.lit(now), F.col("cleanup_hours").cast("bigint") * F.lit(-3_600_000))
    is_log = F.col("decided_backup_type") == "LOG"
    base = F.when(is_log, F.col("latest_backup")).otherwise(F.lit(now))
    cut = F.when(base.isNotNull() & aged.isNotNull(), F.least(F.lit(now), base, aged))
    return decided.join(latest, ["server_id", "name"], "left").withColumn("cleanup_before", cut)


def stripe_numbers(decided: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per backup file and mirror group with its directory, spread over the targets of the policy.

    ``targets``: server_id, policy_id, mirror, directory_no, path. A file count that is no
    multiple of the directory count fills directories as far as its files go; none is
    placed in a directory that does not exist.
    """
    directories = F.greatest(F.col("directory_count"), F.lit(1))
    per_folder = F.greatest(int_div(F.col("file_count") + directories - 1, directories), F.lit(1))
    files = decided.withColumn("file_number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("file_count"))))
    files = files.withColumn("directory_no", int_div(F.col("file_number") - 1, per_folder) + 1)
    return files.join(targets, ["server_id", "policy_id", "directory_no"], "left")


def number_targets(targets: DataFrame) -> DataFrame:
    """Number the target directories of each policy and mirror group; a policy lists at most 64."""
    return number_rows(targets, ["server_id", "policy_id", "mirror"], [F.col("position"), F.col("path")], "directory_no", bounded=True)


def backup_path_parts(decided: DataFrame, now: datetime, separator: str = "\\") -> DataFrame:
    """Directory and file-name template of each database with all tokens but the file number filled in.

    Needs ``server_name, instance_name, service_name, cluster_name, description,
    major_version, minor_version`` beside the decided columns; missing ones count as NULL. A
    policy may bring templates of its own: ``directory_structure, file_name_structure``, for
    databases in an availability group ``group_directory_structure,
    group_file_name_structure``. An empty directory structure means no sub-directories; one
    that is NULL means the usual template.
    """
    def column(name: str) -> Column:
        return F.col(name) if name in decided.columns else F.lit(None).cast("string")

    grouped = F.col("availability_group").isNotNull()
    unused = {
        "{Partial}": ~F.col("read_write_filegroups"),
        "{CopyOnly}": ~F.col("copy_only"),
        "{ClusterName}": column("cluster_name").isNull(),
        "{AvailabilityGroupName}": ~grouped,
        "{InstanceName}": column("instance_name").isNull(),
        "{ServiceName}": column("service_name").isNull(),
        "{Description}": column("description").isNull(),
    }
    single = {"{FileNumber}": F.col("file_count") == 1, "{NumberOfFiles}": F.col("file_count") == 1}
    kind = F.col("decided_backup_type")
    values = {
        "{DirectorySeparator}": F.lit(separator),
        "{ServerName}": column("server_name"), "{InstanceName}": column("instance_name"),
        "{ServiceName}": column("service_name"), "{ClusterName}": column("cluster_name"),
        "{AvailabilityGroupName}": column("availability_group"), "{BackupType}": kind,
        "{Partial}": F.lit("PARTIAL"), "{CopyOnly}": F.lit("COPY_ONLY"),
        "{Description}": F.trim(F.translate(column("description"), '\\/:*?"<>|', "")),
        "{MajorVersion}": column("major_version"), "{MinorVersion}": column("minor_version"),
        **templates.date_tokens(F.lit(now)),
    }
    fs_name = templates.file_system_name(F.col("name"))
    extension = None
    for label, text in templates.FILE_EXTENSIONS.items():
        extension = F.when(kind == label, text) if extension is None else extension.when(kind == label, text)
    folder = F.when(grouped, F.coalesce(column("group_directory_structure"), F.lit(templates.GROUP_DIRECTORY))).otherwise(
        F.coalesce(column("directory_structure"), F.lit(templates.DIRECTORY))
    )
    file = F.when(grouped, F.coalesce(column("group_file_name_structure"), F.lit(templates.GROUP_FILE))).otherwise(
        F.coalesce(column("file_name_structure"), F.lit(templates.FILE))
    )
    file_values = {**values, "{NumberOfFiles}": F.col("file_count"), "{FileExtension}": extension}
    # Templates without their unused tokens are few: tidied once for each set of tokens, not for each database.
    flags = {f"_unused_{token[1:-1]}": F.coalesce(condition, F.lit(False)) for token, condition in {**unused, **single}.items()}
    keyed = decided.withColumns({"_folder": folder, "_file": file, **flags})
    shape = ["_folder", "_file", *flags]
    dropped = {token: F.col(f"_unused_{token[1:-1]}") for token in unused}
    shapes = keyed.select(*shape).distinct().withColumns({
        "_tidy_folder": templates.tidy_directory(templates.drop_tokens(F.col("_folder"), dropped)),
        "_tidy_file": templates.tidy_file(templates.drop_tokens(F.col("_file"), {**dropped, **{t: F.col(f"_unused_{t[1:-1]}") for t in single}})),
    })
    return keyed.join(shapes, shape).withColumns({
        "directory": templates.fill_tokens(F.col("_tidy_folder"), {**values, "{DatabaseName}": fs_name}),
        "file_template": templates.fill_tokens(F.col("_tidy_file"), file_values),
        "file_system_name": fs_name,
    }).select(*decided.columns, *[c for c in ("directory", "file_template", "file_system_name") if c not in decided.columns])


def backup_paths(files: DataFrame, separator: str = "\\") -> DataFrame:
    """Full path of each backup file, shortening a database name that would not fit."""
    c = F.col
    folder = F.concat(c("path"), F.when(c("directory") == "", "").otherwise(F.concat(F.lit(separator), c("directory"))))
    number = templates.file_number_text(c("file_number"), c("file_count"))
    sample = F.replace(F.replace(c("file_template"), F.lit("{DatabaseName}"), c("file_system_name")), F.lit("{FileNumber}"), number)
    name = templates.shortened_name(c("file_system_name"), F.length(folder) + F.lit(len(separator)) + F.length(sample))
    file = F.replace(F.replace(c("file_template"), F.lit("{DatabaseName}"), name), F.lit("{FileNumber}"), number)
    return files.withColumn("file_path", F.concat(folder, F.lit(separator), file))
