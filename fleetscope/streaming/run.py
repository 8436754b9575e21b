"""Running streams to files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, in bounded micro-batches, and stop."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def for_each_available(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch to ``action(batch, batch_id)``; a replayed batch keeps its id."""
    query = (
        stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


class BatchState:
    """A small table that each micro-batch of a stream hands to the next, kept in the shared folder ``folder``.

    A replayed batch reads what it read before and replaces what it wrote. A stream with a
    new checkpoint goes on from the newest table of the ones before it. Only the last two
    versions of a stream stay.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str):
        self._spark, self._folder = spark, folder
        self._own = f"{folder}/run={hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def _list(self, path: str) -> list:
        jvm = self._spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        return list(files.listStatus(place)) if files.exists(place) else []

    def before(self, batch_id: int) -> DataFrame | None:
        """The table that batch ``batch_id`` starts from."""
        if batch_id > 0:
            return self._spark.read.parquet(f"{self._own}/version={batch_id - 1}")
        runs = [r.getPath().toString() for r in self._list(self._folder)]
        others = [v for r in runs if not r.endswith(self._own.rsplit("/", 1)[1]) for v in self._list(r)]
        if not others:
            return None
        newest = max(others, key=lambda v: (v.getModificationTime(), v.getPath().getName()))
        return self._spark.read.parquet(newest.getPath().toString())

    def keep(self, table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{self._own}/version={batch_id}")
        jvm = self._spark.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(f"{self._own}/version={batch_id - 2}")
        old.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
