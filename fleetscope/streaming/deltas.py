"""Session deltas on a stream of samples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.keys import SK
from fleetscope.operators.deltas import METRICS, previous_collections, session_deltas
from fleetscope.operators.ranking import best_row
from fleetscope.runtime import freeze
from fleetscope.streaming.run import BatchState, for_each_available


def delta_batches(
    samples: DataFrame, path: str, state: str, checkpoint: str, metrics: Sequence[str] = tuple(METRICS), allow_negative: bool = False,
    lateness: timedelta | None = None,
) -> None:
    """Deltas of each micro-batch against the server's previous collection, whenever that was.

    The samples of a server's two latest collections go from batch to batch, so a
    collection may arrive in two batches. A row comes out for every sample, also for
    the first of a request; guards and ``cpu_delta`` are those of the batch form. The output of
    a batch id is replaced as a whole, so a replayed batch changes nothing.

    With ``lateness`` the samples of that much time before a server's newest collection, and
    of the collection before them, are kept, and collections may arrive in any order
    within it: a late one gets its deltas, and the collection after it comes out once more,
    against its new neighbour. ``read_deltas`` takes the last word on each sample.
    """

    def compute(batch: DataFrame, batch_id: int) -> None:
        kept = BatchState(batch.sparkSession, state, checkpoint)
        arrived = batch.withColumn("is_new", F.lit(True)).persist()
        known = kept.before(batch_id)
        both = arrived if known is None else arrived.unionByName(known.withColumn("is_new", F.lit(False)))
        at = ["server_id", "collection_time"]
        if lateness is None:
            found = session_deltas(both, metrics, allow_negative).filter("is_new")
        else:
            touched = freeze(_touched(both, arrived))
            needed = touched.select(*at).unionByName(touched.select("server_id", F.col("previous_time").alias("collection_time"))).distinct()
            found = session_deltas(both.join(needed, at, "left_semi"), metrics, allow_negative).join(touched, at, "left_semi")
        names = [c for c in found.columns if c in SK or c.endswith("_delta")]
        found.select(*names).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        times = freeze(both.select(*at).distinct())
        last = times.groupBy("server_id").agg(F.max("collection_time").alias("last"))
        if lateness is not None:
            last = last.withColumn("last", F.col("last") - F.lit(lateness))
        second = (
            times.join(last, "server_id").filter("collection_time < last")
            .groupBy("server_id").agg(F.max("collection_time").alias("collection_time"))
        )
        recent = times.join(last, "server_id").filter("collection_time >= last").select(*at).unionByName(second.select(*at))
        kept.keep(both.drop("is_new").join(freeze(recent), at, "left_semi"), batch_id)
        arrived.unpersist()

    for_each_available(samples, compute, checkpoint)


def _touched(both: DataFrame, arrived: DataFrame) -> DataFrame:
    """Collections that arrived and those right after one that arrived, with the collection before each."""
    at = ["server_id", "collection_time"]
    around = previous_collections(both).join(arrived.select(*at).distinct().withColumn("_came", F.lit(True)), at, "left")
    before = arrived.select("server_id", F.col("collection_time").alias("previous_time")).distinct().withColumn("_neighbour", F.lit(True))
    return around.join(before, ["server_id", "previous_time"], "left").filter("_came or _neighbour").select(*at, "previous_time")


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """The deltas that ``delta_batches`` wrote, each sample as the last batch that touched it says."""
    rows = spark.read.parquet(path)
    return best_row(rows, SK, [F.col("batch_id")], [c for c in rows.columns if c not in (*SK, "batch_id")])
