"""Delimited selector lists such as ``USER_DATABASES,-Sales%``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions.semantics import name_part, strip_brackets

# Keywords that stand for a pattern and a type flag.
DATABASE_KEYWORDS = ("ALL_DATABASES", "SYSTEM_DATABASES", "USER_DATABASES", "AVAILABILITY_GROUP_DATABASES")
ALL_KEYWORDS = {"indexes": ("ALL_INDEXES", "%.%.%.%"), "objects": ("ALL_OBJECTS", "%.%.%")}
KINDS = ("databases", "groups", "filegroups", "objects", "indexes", "words")


def selector_items(spec: Column, delimiter: str = ",") -> Column:
    """Trimmed items of a list; NULL for no list."""
    mark = "\\" + delimiter if not delimiter.isalnum() else delimiter
    clean = F.regexp_replace(spec, r"[\r\n]", "")
    return F.split(F.trim(F.regexp_replace(clean, f" *{mark} *", delimiter)), mark)


def _database(item: Column) -> dict[str, Column]:
    word = F.upper(item)
    return {
        "database_type": F.when(word == "SYSTEM_DATABASES", "S").when(word == "USER_DATABASES", "U"),
        "in_group": F.when(word == "AVAILABILITY_GROUP_DATABASES", True),
        "name": F.when(word.isin(*DATABASE_KEYWORDS), "%").otherwise(strip_brackets(item)),
    }


def _dotted(item: Column, kind: str) -> dict[str, Column]:
    keyword, pattern = ALL_KEYWORDS[kind]
    item = F.when(F.upper(item) == keyword, pattern).otherwise(item)
    part = [name_part(item, i) for i in range(1, 5)]
    four = part[3].isNotNull()
    if kind == "objects":
        return {
            "database_name": F.when(~four, part[2]), "schema_name": F.when(~four, part[1]),
            "object_name": F.when(~four, part[0]),
        }
    return {
        "database_name": F.coalesce(part[3], part[2]),
        "schema_name": F.when(four, part[2]).otherwise(part[1]),
        "object_name": F.when(four, part[1]).otherwise(part[0]),
        "index_name": F.when(four, part[0]).otherwise("%"),
    }


def _columns(item: Column, kind: str) -> dict[str, Column]:
    if kind == "databases":
        return _database(item)
    if kind in ALL_KEYWORDS:
        return _dotted(item, kind)
    if kind == "groups":
        return {"name": F.when(F.upper(item) == "ALL_AVAILABILITY_GROUPS", "%").otherwise(strip_brackets(item))}
    if kind == "filegroups":
        item = F.when(F.upper(item) == "ALL_FILEGROUPS", "%.%").otherwise(item)
        return {"database_name": name_part(item, 2), "filegroup_name": name_part(item, 1)}
    return {"name": item}


def selector_array(spec: Column, kind: str = "databases", delimiter: str = ",") -> Column:
    """A list as an array of structs: position, include or exclude, and name patterns.

    The array is no bigger than the text of its one row.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown selector kind {kind!r}")

    def entry(item: Column, index: Column) -> Column:
        excluded = item.startswith("-")
        bare = F.when(excluded, F.substring(item, F.lit(2), F.length(item))).otherwise(item)
        return F.struct(
            (index + 1).alias("position"), item.alias("item"), (~excluded).alias("selected"),
            *[column.alias(name) for name, column in _columns(bare, kind).items()],
        )

    return F.transform(selector_items(spec, delimiter), entry)


def expand_selectors(policies: DataFrame, kind: str = "databases", delimiter: str = ",") -> DataFrame:
    """One row per list item. ``policies`` has ``policy_id`` and ``spec``; a NULL list has no rows."""
    keys = [c for c in policies.columns if c != "spec"]
    return policies.select(*keys, F.explode(selector_array(F.col("spec"), kind, delimiter)).alias("_s")).select(*keys, "_s.*")


def first_occurrence(items: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the first of repeated items, as an aggregate."""
    rest = [c for c in items.columns if c not in keys]
    first = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("position")).alias("_f"))
    return first.select(*keys, "_f.*")
