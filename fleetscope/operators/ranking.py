"""Row numbers and best rows that hold when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.runtime import freeze

PACK_ROWS = 1000


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "row_number", bounded: bool = False,
    packed: Sequence[str] = (), leading: int = 0,
) -> DataFrame:
    """``row_number`` within ``group``; ``order`` must be total for a repeatable result.

    The rows are range-partitioned over (group, order) and frozen in that order; each slice is
    numbered on its own and shifted by the rows of the slices before it, so a group may be of
    any size. Only where the definition bounds a group (``bounded``) is a plain window used.

    Rows that share ``packed`` may travel together, at most ``PACK_ROWS`` in one, so that what they
    share is written once. ``packed`` has the group, the columns of the first ``leading`` entries of
    ``order`` and, for rows that are dealt already, the columns they are dealt by.
    """
    if bounded:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return _number_by_slices(df, group, order, name, packed, leading)


def number_small_groups(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "row_number", most: int = 10_000
) -> DataFrame:
    """``row_number`` where groups are small as a rule but may be of any size.

    Groups of at most ``most`` rows are numbered by a window, so their rows move once and are
    not written again; only larger ones are dealt in slices.
    """
    rows = freeze(df.drop(name))
    large = freeze(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*group))
    if large.isEmpty():
        return number_rows(rows, group, order, name, bounded=True)
    marked = null_safe_join(rows, large.withColumn("_large", F.lit(True)), group, "left")
    small = number_rows(marked.filter("_large is null").drop("_large"), group, order, name, bounded=True)
    return small.unionByName(number_rows(marked.filter("_large").drop("_large"), group, order, name))


def _pack(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one ``by`` among ``PACK_ROWS`` that follow each other as one row, in whose ``_rows`` they stand."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    packs = df.withColumn("_pack", F.floor(F.monotonically_increasing_id() / PACK_ROWS)).groupBy(*by, "_pack")
    return packs.agg(F.collect_list(rest).alias("_rows")).drop("_pack")


def _number_by_slices(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, packed: Sequence[str] = (), leading: int = 0
) -> DataFrame:
    """Freeze the rows, deal them by range once and freeze them in order; all else is read from that table.

    Within a sorted slice consecutive ids are places; each group's part of a slice is
    shifted by the group's rows in the slices before it. The table of shifts has a row per group
    and slice boundary; it is frozen too, so that a small one is broadcast. Packs are dealt by
    group and leading order, so rows that tie in these are in one slice, and opened there.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by, part = [*[F.col(g) for g in group], *order], [*group, "_slice"]
    rows = df.drop(name)
    if packed:
        dealt = freeze(_pack(rows, packed)).repartitionByRange(slices, *by[:len(group) + leading])
        dealt = dealt.select(*packed, F.inline("_rows")).select(*rows.columns)
    else:
        dealt = freeze(rows).repartitionByRange(slices, *by)
    placed = dealt.sortWithinPartitions(*by)
    placed = freeze(placed.withColumns({"_slice": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    shifts = freeze(shifts.select(*part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    numbered = null_safe_join(placed, shifts, part, "inner")
    return numbered.withColumn(name, (F.col("_place") + F.col("_shift") + 1).cast("int")).drop("_slice", "_place", "_shift")


def best_row(
    df: DataFrame, keys: Sequence[str], best_by: Sequence[Column], columns: Sequence[str],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The row with the greatest ``best_by`` per key, as a partial aggregate.

    Takes the place of ``row_number() = 1``: nothing but one candidate per key and
    map task is shuffled, so a hot key costs no more than any other. ``extra`` adds
    aggregates over all rows of the key.
    """
    extra = extra or {}
    payload = F.struct(*[F.col(c) for c in columns])
    ranked = df.groupBy(*keys).agg(
        F.max_by(payload, F.struct(*best_by)).alias("_best"), *[column.alias(name) for name, column in extra.items()]
    )
    return ranked.select(*keys, *[F.col("_best")[c].alias(c) for c in columns], *extra)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys match; the right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_in_place(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``null_safe_join(left, right, keys, "left")`` by a window over both sides' rows.

    A join deals both sides by all its keys. A window asks only that rows of one key are
    together, so where both sides are dealt by some of the keys, as after ``freeze_dealt``, none
    of them moves. Only what has one key on the right is gathered.
    """
    values = [c for c in right.columns if c not in keys]
    facts = right.select(*keys, F.struct(*values).alias("_facts"))
    both = left.withColumn("_is_row", F.lit(True)).unionByName(facts, allowMissingColumns=True)
    found = both.withColumn("_found", F.collect_list("_facts").over(Window.partitionBy(*keys))).filter("_is_row")
    kept = [F.col(c) if found.schema[c].dataType == left.schema[c].dataType else F.col(c).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    return found.select(*kept, F.explode_outer("_found").alias("_facts")).select(*left.columns, *[F.col("_facts")[c].alias(c) for c in values])


def exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Whether ``other`` has a row with the same keys; NULL keys never match."""
    marked = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(keys), "left").withColumn(name, F.col(name).isNotNull())


def spread_group_value(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Whole-group aggregates on every row: aggregate first, then join back.

    A window would sort a hot group in one task; here the aggregate is combined
    map-side and adaptive execution may split the hot side of the join.
    """
    totals = df.groupBy(*keys).agg(*[column.alias(name) for name, column in aggregates.items()])
    return null_safe_join(df.drop(*aggregates), totals, keys, "left")


def dense_number(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """``dense_rank`` of ``value`` within ``group`` through its distinct values."""
    distinct = df.select(*group, value).distinct()
    numbered = number_rows(distinct, group, [F.col(value).asc_nulls_first()], name)
    return null_safe_join(df, numbered, [*group, value], "left")
