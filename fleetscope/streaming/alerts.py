"""Alerts with cooldown on a stream of error events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.alerts import COOLDOWN_SECONDS, fire_with_cooldown, match_rules
from fleetscope.streaming.run import BatchState, for_each_available

_KEYS = ["server_id", "rule"]


def alert_batches(events: DataFrame, path: str, state: str, checkpoint: str, seconds: int = COOLDOWN_SECONDS) -> None:
    """Alerts of each micro-batch through the batch operator, so a hot server is spread over tasks.

    The last fired time per (server, rule) goes from batch to batch, also to a stream with
    a new checkpoint. Events that fall into its cooldown, or before it, can no longer
    fire; on the others the batch starts afresh. Output and state of a batch id are
    replaced as a whole, so a replayed batch changes nothing.
    """

    def fire(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = BatchState(spark, state, checkpoint)
        matched = match_rules(batch).persist()
        known = kept.before(batch_id)
        if known is None:
            known = matched.select(*_KEYS, F.col("event_time").alias("last_fired")).limit(0)
        due = F.col("event_time") >= F.col("last_fired") + F.expr(f"interval {int(seconds)} seconds")
        waiting = matched.join(known, _KEYS, "left").filter(F.col("last_fired").isNull() | due).drop("last_fired")
        fire_with_cooldown(waiting, seconds).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        fired = spark.read.parquet(f"{path}/batch_id={batch_id}").select(*_KEYS, F.col("event_time").alias("last_fired"))
        kept.keep(known.unionByName(fired).groupBy(*_KEYS).agg(F.max("last_fired").alias("last_fired")), batch_id)
        matched.unpersist()

    for_each_available(events, fire, checkpoint)
