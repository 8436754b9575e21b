"""Differences between consecutive collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.keys import SK
from fleetscope.runtime import freeze

METRICS = [
    "physical_io", "reads", "physical_reads", "writes", "tempdb_allocations", "tempdb_current",
    "context_switches", "used_memory", "max_used_memory",
]
CPU_METRICS = ["cpu", "thread_cpu"]


def previous_collections(samples: DataFrame) -> DataFrame:
    """Each collection of a server with the ones before and after it.

    Works on the distinct collection times, of which a server has a bounded number.
    """
    times = samples.select("server_id", "collection_time").distinct()
    in_order = Window.partitionBy("server_id").orderBy("collection_time")
    return times.select(
        "server_id", "collection_time",
        F.lag("collection_time").over(in_order).alias("previous_time"),
        F.lead("collection_time").over(in_order).alias("next_time"),
    )


def num_events(samples: DataFrame) -> DataFrame:
    """How many rows each request has within one collection."""
    return samples.groupBy(*SK).agg(F.count(F.lit(1)).alias("num_events"))


def session_deltas(samples: DataFrame, metrics: Sequence[str] = tuple(METRICS), allow_negative: bool = False) -> DataFrame:
    """Change of each metric since the server's previous collection, per request.

    A delta is NULL unless the request appears in both collections, runs since the same
    start time, and did not shrink. A request counts once per collection; of several copies
    the greatest row stands. Every sample is sent to its own collection and to the next one,
    where one aggregate meets both: one scan and one shuffle, and the history of a session is
    never gathered.
    """
    cpu = [m for m in CPU_METRICS if m in samples.columns]
    paired = _paired(samples, [*metrics, *cpu])
    out = {}
    for m in metrics:
        change = F.col(m) - F.col(f"_before_{m}")
        guard = F.col("_valid") if allow_negative else F.col("_valid") & (change >= 0)
        out[f"{m}_delta"] = F.when(guard, change)
    if len(cpu) == len(CPU_METRICS):
        out["cpu_delta"] = _cpu_delta()
    paired = paired.withColumns(out)
    return paired.drop(*[c for c in paired.columns if c.startswith("_")])


def cpu_delta(samples: DataFrame) -> DataFrame:
    """Thread CPU where it grew more than the request's own CPU, else the request's."""
    paired = _paired(samples, CPU_METRICS).withColumn("cpu_delta", _cpu_delta())
    return paired.drop(*[c for c in paired.columns if c.startswith("_")])


def _cpu_delta() -> Column:
    thread = F.col("thread_cpu") - F.col("_before_thread_cpu")
    own = F.col("cpu") - F.col("_before_cpu")
    value = F.when((thread > own) & (thread > 0), thread).when(own >= 0, own)
    return F.when(F.col("_valid"), value)


def _paired(samples: DataFrame, metrics: Sequence[str]) -> DataFrame:
    collections = freeze(previous_collections(samples).drop("previous_time"))
    rest = [c for c in samples.columns if c not in SK]
    slots = F.array(
        F.struct(F.col("collection_time").alias("slot"), F.lit(True).alias("own")),
        F.struct(F.col("next_time").alias("slot"), F.lit(False).alias("own")),
    )
    sent = (
        samples.join(collections, ["server_id", "collection_time"])
        .withColumn("_slot", F.explode(slots)).filter("_slot.slot is not null")
        .select("server_id", F.col("_slot.slot").alias("collection_time"), "session_id", "request_id",
                F.col("_slot.own").alias("_own"), F.struct(*rest).alias("_row"))
    )
    met = sent.groupBy(*SK).agg(
        F.max(F.when(F.col("_own"), F.col("_row"))).alias("_now"), F.max(F.when(~F.col("_own"), F.col("_row"))).alias("_before")
    ).filter("_now is not null")
    same_start = F.col("_before.last_request_start_time") == F.col("_now.last_request_start_time")
    return met.select(
        *SK, *[F.col(f"_now.{c}").alias(c) for c in rest], *[F.col(f"_before.{m}").alias(f"_before_{m}") for m in metrics],
        F.coalesce(same_start, F.lit(False)).alias("_valid"),
    )
