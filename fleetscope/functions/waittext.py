"""Wait descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.locktext import first_group, page_class

# Wait types of parallel exchanges, never reported as a session's own wait.
PARALLEL_WAITS = ("CXPACKET", "CXCONSUMER", "CXSYNC_PORT", "CXSYNC_CONSUMER")


def is_page_latch(wait_type: Column) -> Column:
    return wait_type.rlike("^PAGE.*LATCH_")


def is_lock_wait(wait_type: Column) -> Column:
    return wait_type.startswith("LCK_")


def is_named_latch(wait_type: Column) -> Column:
    return wait_type.startswith("LATCH_")


def keeps_resource(wait_type: Column) -> Column:
    """Wait types whose resource text is worth keeping."""
    return (
        is_page_latch(wait_type) | wait_type.isin(*PARALLEL_WAITS)
        | is_named_latch(wait_type) | (wait_type == "OLEDB")
    )


def without_latch_note(resource: Column) -> Column:
    """Resource text without a trailing `` (LATCH ...`` note."""
    return F.rtrim(F.regexp_replace(resource, r"(?s) \(LATCH .*$", ""))


def wait_detail(wait_type: Column, resource: Column, database_name: Column) -> Column:
    """Suffix that names the page, plan node, latch or linked server waited for."""
    page = F.regexp_extract(resource, r":(\d+)$", 1).try_cast("bigint")
    page_text = F.concat(
        F.lit(":"), F.coalesce(database_name, F.lit("(null)")), F.lit(":"),
        F.regexp_extract(resource, r"^[^:]*:(.*):[^:]*$", 1),
        F.lit("("), page_class(page), F.lit(")"),
    )
    node = F.concat(F.lit(":"), F.coalesce(first_group(resource, r"nodeId=([^ ]*)"), F.lit("")))
    latch = F.concat(F.lit(" ["), F.regexp_extract(resource, r"^([^ ]*)", 1), F.lit("]"))
    linked = F.concat(
        F.lit("["), F.regexp_extract(resource, r"^(.*) \(SPID=", 1), F.lit(":"),
        F.regexp_extract(resource, r"\(SPID=([^)]*)\)", 1), F.lit("]"),
    )
    return (
        F.when(is_page_latch(wait_type), page_text)
        .when(wait_type.isin(*PARALLEL_WAITS), node)
        .when(is_named_latch(wait_type), latch)
        .when((wait_type == "OLEDB") & resource.rlike(r"\(SPID=.*\)"), linked)
        .otherwise(F.lit(""))
    )


def wait_text(wait_ms: Column, wait_type: Column, detail: Column) -> Column:
    """``(12ms)TYPE:detail``; NULL where the session does not wait."""
    return F.concat(F.lit("("), wait_ms.cast("string"), F.lit("ms)"), wait_type, detail)


def wait_group_text(count: Column, low: Column, mean: Column, high: Column, wait_type: Column) -> Column:
    """``(nx: min/avg/max ms)TYPE`` with shorter forms for one, two or equal waits."""
    one = high.cast("string")
    spread = F.when(count == 2, F.concat_ws("/", low, high)).otherwise(F.concat_ws("/", low, mean, high))
    amounts = F.when((count == 1) | (low == high), one).otherwise(spread)
    return F.concat(F.lit("("), count.cast("string"), F.lit("x: "), amounts, F.lit("ms)"), wait_type)
