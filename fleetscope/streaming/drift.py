"""Definition drift as definitions of secondaries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators.jobs import definition_drift
from fleetscope.runtime import cut_lineage
from fleetscope.streaming.run import BatchState, for_each_available


def stream_drift(secondary: DataFrame, primary: DataFrame, path: str, checkpoint: str) -> None:
    """Compare each arriving batch of definitions with the stored ones and write the differences.

    A batch holds whole definition sets of its servers. Its result replaces the folder of
    its own batch id, so a replay writes the same rows again.
    """
    def compare(batch: DataFrame, batch_id: int) -> None:
        servers = batch.select("secondary_id").distinct()
        reference = primary.join(servers, "secondary_id", "left_semi")
        found = definition_drift(reference, batch, ["secondary_id"]).withColumn("batch_id", F.lit(batch_id))
        (
            found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(path)
        )

    for_each_available(secondary, compare, checkpoint)


def stream_drift_parts(secondary: DataFrame, primary: DataFrame, path: str, state: str, checkpoint: str) -> None:
    """Drift of definition sets that arrive in parts, over any number of batches.

    What arrived so far goes from batch to batch as compared columns, each row once. A batch
    compares the servers whose jobs it changed: those of which the order-free digest over a
    job's rows is another than before. The folder of such a server is replaced, so the
    table always holds the drift of all that arrived, and a replay writes it again.
    """
    def digests(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != "secondary_id"]
        return rows.groupBy("secondary_id", "job_name").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*rest)).alias("digest"))

    def compare(batch: DataFrame, batch_id: int) -> None:
        kept = BatchState(batch.sparkSession, state, checkpoint)
        rows = batch.filter("job_name is not null").distinct()
        known = kept.before(batch_id)
        kept.keep(rows if known is None else rows.unionByName(known).distinct(), batch_id)
        so_far = kept.before(batch_id + 1)
        now = digests(so_far)
        changed = now if known is None else now.join(digests(known), now.columns, "left_anti")
        servers = cut_lineage(changed.select("secondary_id").distinct())
        found = definition_drift(primary.join(servers, "secondary_id", "left_semi"), so_far.join(servers, "secondary_id", "left_semi"), ["secondary_id"])
        # A server without drift any more must lose its old rows: a marker row replaces them.
        marks = servers.select("secondary_id", F.lit(None).cast("string").alias("side"))
        out = found.unionByName(marks, allowMissingColumns=True)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("secondary_id").parquet(path)

    for_each_available(secondary, compare, checkpoint)


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """The drift that ``stream_drift_parts`` wrote, without its markers."""
    return spark.read.parquet(path).filter("side is not null")
