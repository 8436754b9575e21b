"""Ids and page classes read out of lock and wait resource text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page numbers and spacing of the allocation bitmap pages.
PFS_SPACING = 8088
GAM_SPACING = 511232


def page_class(page: Column) -> Column:
    """Allocation page class of a page number; ``*`` for data, NULL for none."""
    def every(spacing: int, offset: int = 0) -> Column:
        return (page - F.lit(offset)) % F.lit(spacing) == 0

    return (
        F.when((page == 1) | every(PFS_SPACING), "PFS")
        .when((page == 2) | every(GAM_SPACING), "GAM")
        .when((page == 3) | every(GAM_SPACING, 1), "SGAM")
        .when((page == 6) | every(GAM_SPACING, 6), "DCM")
        .when((page == 7) | every(GAM_SPACING, 7), "BCM")
        .when(page.isNotNull(), "*")
    )


def first_group(text: Column, pattern: str) -> Column:
    """First capture group, NULL where the pattern does not occur."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(F.length(found) > 0, found)


def keyed_number(text: Column, key: str) -> Column:
    """Number after ``key = `` up to the next comma."""
    return F.trim(first_group(text, rf"{key} = ([^,]*)")).try_cast("bigint")


def colon_part(text: Column, position: int) -> Column:
    """Part of an ``a:b:c`` text, counted from 1."""
    return F.try_element_at(F.split(text, ":"), F.lit(position))


def lock_resource_columns(kind: Column, subtype: Column, text: Column, entity: Column) -> dict[str, Column]:
    """Parsed columns of one lock row.

    A key such as ``schema_id`` also ends ``..._schema_id``, as in the source text
    format, so the first occurrence of the key wins.
    """
    paged = kind.isin("PAGE", "EXTENT", "RID")
    return {
        "object_id": F.when(kind == "OBJECT", entity).otherwise(keyed_number(text, "object_id")),
        "file_id": F.when(kind == "FILE", F.trim(text).try_cast("bigint")).when(
            paged, colon_part(text, 1).try_cast("bigint")
        ),
        "page_no": F.when(paged, colon_part(text, 2).try_cast("bigint")),
        "hobt_id": F.when(kind.isin("PAGE", "KEY", "RID", "HOBT"), entity),
        "allocation_unit_id": F.when(kind == "ALLOCATION_UNIT", entity),
        "index_id": F.when(subtype != "SERVER_PRINCIPAL", keyed_number(text, "index_id or stats_id")),
        "schema_id": keyed_number(text, "schema_id"),
        "principal_id": keyed_number(text, "principal_id"),
    }


def spaced_value(text: Column, key: str) -> Column:
    """Value after ``key=`` up to the next blank."""
    return first_group(text, rf"{key}=([^ ]*)")


def block_info(text: Column) -> Column:
    """What a blocked request waits for, as one struct."""
    kind = first_group(text, r"^([^ ]*) ")
    hobt = F.when(
        kind.isin("pagelock", "extentlock", "ridlock"), spaced_value(text, "associatedObjectId")
    ).when(kind.isin("keylock", "hobtlock", "allocunitlock"), spaced_value(text, "hobtid"))
    return F.struct(
        kind.alias("lock_type"),
        spaced_value(text, "dbid").try_cast("bigint").alias("database_id"),
        F.when(kind == "objectlock", spaced_value(text, "objid")).try_cast("bigint").alias("object_id"),
        F.when(kind == "filelock", spaced_value(text, "fileid")).try_cast("bigint").alias("file_id"),
        hobt.try_cast("bigint").alias("hobt_id"),
        F.when(kind == "applicationlock", spaced_value(text, "hash")).alias("applock_hash"),
        F.when(kind == "metadatalock", spaced_value(text, "subresource")).alias("metadata_resource"),
        F.when(kind == "metadatalock", first_group(text, r"classid=(.*?)(?: dbid=|$)")).alias("metadata_class_id"),
    )


def metadata_schema_id(info: Column) -> Column:
    """Schema id of a metadata lock on a schema (``schema_id = n``)."""
    return F.when(
        info["metadata_resource"] == "SCHEMA", first_group(info["metadata_class_id"], r" = (\d+)")
    ).try_cast("bigint")
