"""Lock counts, names and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.locktext import lock_resource_columns, page_class
from fleetscope.functions.semantics import escape_markup, scrub_control
from fleetscope.keys import K, SK
from fleetscope.operators.ranking import number_small_groups

RAW_KEYS = [*K, "request_session_id", "request_request_id"]
RESOURCE_IDS = ["object_id", "file_id", "hobt_id", "allocation_unit_id", "index_id", "schema_id", "principal_id"]
LOCK_GROUP = [
    "resource_type", "database_name", "object_id", "file_id", "page_type", "hobt_id", "allocation_unit_id",
    "index_id", "schema_id", "principal_id", "request_mode", "request_status", "resource_description",
]


def lock_inventory(locks: DataFrame) -> DataFrame:
    """Locks counted by what they lock, for whom and in which mode.

    The count combines map-side, so a session that holds most locks of the fleet does
    not make a heavy task. The free resource text is kept only where no id was found.
    """
    text = F.rtrim("resource_description")
    subtype = F.coalesce("resource_subtype", F.lit(""))
    parsed = lock_resource_columns(
        F.col("resource_type"), subtype, F.col("resource_description"), F.col("resource_associated_entity_id")
    )
    rows = locks.select(
        *K, F.col("request_session_id").alias("session_id"), F.col("request_request_id").alias("request_id"),
        F.concat("resource_type", F.when(subtype == "", F.lit("")).otherwise(F.concat(F.lit("."), subtype))).alias("resource_type"),
        F.coalesce("database_name", F.lit("(null)")).alias("database_name"),
        *[column.alias(name) for name, column in parsed.items()],
        "request_mode", "request_status", text.alias("_text"),
    ).withColumn("page_type", page_class(F.col("page_no")))
    unknown = F.coalesce(*RESOURCE_IDS).isNull()
    rows = rows.withColumn("resource_description", F.when(unknown, F.nullif(F.col("_text"), F.lit(""))))
    return rows.groupBy(*SK, *LOCK_GROUP).agg(F.count(F.lit(1)).alias("request_count"))


def session_locks(sessions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Counted locks of the collected sessions, with the request start time."""
    return sessions.select(*SK, "start_time").join(inventory, SK)


def resolve_object_names(
    locks: DataFrame, alloc_units: DataFrame, partitions: DataFrame, objects: DataFrame,
    indexes: DataFrame, schemas: DataFrame, principals: DataFrame,
) -> DataFrame:
    """Object, index, schema and principal names of locks, looked up per server and database.

    The partition comes from the heap-or-tree id, from the container of an in-row or
    overflow allocation unit, or by partition id for a large-object unit. Key columns
    are computed first, so every step is an equi-join.
    """
    at = ["server_id", "database_name"]
    au = alloc_units.select(
        *at, "allocation_unit_id", F.col("type").alias("_au_type"), F.col("container_id").alias("_container")
    )
    by_hobt = partitions.select(
        *at, F.col("hobt_id").alias("_hobt"), F.col("object_id").alias("_object_1"), F.col("index_id").alias("_index_1")
    )
    by_id = partitions.select(
        *at, F.col("partition_id").alias("_partition"), F.col("object_id").alias("_object_2"), F.col("index_id").alias("_index_2")
    )
    obj = objects.select(*at, F.col("object_id").alias("_object"), F.col("name").alias("object_name"), F.col("schema_id").alias("_object_schema"))
    idx = indexes.select(*at, F.col("object_id").alias("_object"), F.col("index_id").alias("_index"), F.col("name").alias("index_name"))
    sch = schemas.select(*at, F.col("schema_id").alias("_schema"), F.col("name").alias("schema_name"))
    dp = principals.select(*at, "principal_id", F.col("name").alias("principal_name"))
    in_row = F.col("_au_type").isin(1, 3)
    large = F.col("hobt_id").isNull() & (F.col("_au_type") == 2)
    out = (
        locks.join(au, [*at, "allocation_unit_id"], "left")
        .withColumn("_hobt", F.coalesce("hobt_id", F.when(in_row, F.col("_container"))))
        .withColumn("_partition", F.when(large, F.col("_container")))
        .join(by_hobt, [*at, "_hobt"], "left")
        .join(by_id, [*at, "_partition"], "left")
        .withColumn("_object", F.coalesce("object_id", "_object_1", "_object_2"))
        .withColumn("_index", F.coalesce("index_id", "_index_1", "_index_2"))
        .join(obj, [*at, "_object"], "left")
        .join(idx, [*at, "_object", "_index"], "left")
        .withColumn("_schema", F.coalesce("schema_id", "_object_schema"))
        .join(sch, [*at, "_schema"], "left")
        .join(dp, [*at, "principal_id"], "left")
    )
    names = ["object_name", "index_name", "schema_name", "principal_name"]
    return out.select(*locks.columns, *[scrub_control(F.col(n)).alias(n) for n in names])


def lock_document(named: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Locks of each request as nested arrays: databases, their objects, their locks.

    Locks on the database itself stand apart from those on its objects. A document
    holds at most ``page_rows`` lock groups; further ones follow on the next
    ``page_no``, so no request is gathered whole and none is cut short.
    """
    on_database = F.col("resource_type") == "DATABASE"
    object_name = F.when(~on_database, F.coalesce("object_name", F.lit("(null)")))
    leaf = named.select(
        *SK, "database_name", on_database.alias("on_database"), object_name.alias("object_label"),
        F.when(~on_database, F.col("schema_name")).alias("object_schema"),
        F.when(~on_database, F.col("resource_type")).alias("resource_type"),
        F.when(~on_database, F.col("page_type")).alias("page_type"),
        F.when(~on_database, F.col("index_name")).alias("index_name"),
        F.when(~on_database & F.col("object_name").isNull(), F.col("schema_name")).alias("schema_name"),
        F.when(~on_database, F.col("principal_name")).alias("principal_name"),
        F.when(~on_database, scrub_control(F.col("resource_description"))).alias("resource_description"),
        "request_mode", "request_status",
        # Database locks are counted by lock group, object locks by lock.
        F.when(on_database, F.lit(1)).otherwise(F.col("request_count")).alias("request_count"),
    )
    lock_columns = [
        "resource_type", "page_type", "index_name", "schema_name", "principal_name",
        "resource_description", "request_mode", "request_status",
    ]
    path = ["database_name", "on_database", "object_label", "object_schema"]
    counted = leaf.groupBy(*SK, *path, *lock_columns).agg(F.sum("request_count").alias("request_count"))
    order = [F.col(c).asc_nulls_first() for c in [*path, *lock_columns]]
    paged = number_small_groups(counted, SK, order, "_row").withColumn(
        "page_no", F.floor((F.col("_row") - 1) / page_rows).cast("int")
    )
    page = [*SK, "page_no"]
    lock = F.struct(*lock_columns, "request_count")
    objects = paged.groupBy(*page, *path).agg(F.array_sort(F.collect_list(lock)).alias("locks"))
    database_locks = F.flatten(F.collect_list(F.when(F.col("on_database"), F.col("locks"))))
    object_entries = F.collect_list(
        F.when(~F.col("on_database"), F.struct(F.col("object_label").alias("name"), F.col("object_schema").alias("schema_name"), "locks"))
    )
    databases = objects.groupBy(*page, "database_name").agg(
        F.array_sort(database_locks).alias("database_locks"), F.array_sort(object_entries).alias("objects")
    )
    entry = F.struct(F.col("database_name").alias("name"), "database_locks", "objects")
    return databases.groupBy(*page).agg(F.array_sort(F.collect_list(entry)).alias("databases"))


def lock_document_text(documents: DataFrame) -> DataFrame:
    """Lock documents written as markup text."""
    def attribute(name, value):
        return F.coalesce(F.concat(F.lit(f' {name}="'), escape_markup(scrub_control(value)), F.lit('"')), F.lit(""))

    def lock_text(lock):
        names = [
            "resource_type", "page_type", "index_name", "schema_name", "principal_name",
            "resource_description", "request_mode", "request_status",
        ]
        parts = [attribute(n, lock[n]) for n in names]
        return F.concat(F.lit("<Lock"), *parts, attribute("request_count", lock["request_count"].cast("string")), F.lit("/>"))

    def object_text(entry):
        return F.concat(
            F.lit("<Object"), attribute("name", entry["name"]), attribute("schema_name", entry["schema_name"]), F.lit("><Locks>"),
            F.array_join(F.transform(entry["locks"], lock_text), ""), F.lit("</Locks></Object>"),
        )

    def wrapped(tag, items, render):
        body = F.array_join(F.transform(items, render), "")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))).otherwise(F.lit(""))

    def database_text(entry):
        return F.concat(
            F.lit("<Database"), attribute("name", entry["name"]), F.lit(">"),
            wrapped("Locks", entry["database_locks"], lock_text), wrapped("Objects", entry["objects"], object_text),
            F.lit("</Database>"),
        )

    return documents.select(
        *SK, "page_no", F.array_join(F.transform("databases", database_text), "").alias("locks")
    )
