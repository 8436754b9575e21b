"""Streaming queries: telemetry is written as files, streamed to its end, and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from fleetscope.keys import SK
from fleetscope.operators import deltas, jobs
from fleetscope.runtime import freeze, scratch_path
from fleetscope.schemas import TELEMETRY
from fleetscope.sinks.history import append_history
from fleetscope.sources.telemetry import stream_telemetry
from fleetscope.streaming.alerts import alert_batches
from fleetscope.streaming.cpu import stream_cpu_history
from fleetscope.streaming.deltas import delta_batches, read_deltas
from fleetscope.streaming.drift import read_drift, stream_drift, stream_drift_parts
from fleetscope.streaming.run import write_available
from harness import collectors as batch
from harness.core import query
from harness.sessions import _CPU_SQL as _DELTA_CPU
from harness.sessions import _PAIRS_SQL


def _streamed(v, view: str, name: str, time: str = "collection_time"):
    root = scratch_path(v.spark, f"stream-{name}")
    append_history(v(view), f"{root}/{name}", TELEMETRY[name], time)
    return stream_telemetry(v.spark, root, name), root


def _arrive(rows, path: str, run) -> None:
    """``rows`` as new files of a stream, in as many as they have tasks, which ``run`` takes as one micro-batch."""
    rows.write.mode("append").parquet(path)
    run(rows.sparkSession.readStream.schema(rows.schema).parquet(path))


def _by_collection(v, root: str):
    """The snapshots stored in a folder per collection ``_at`` (microseconds), and these in order."""
    samples = v("fx_snapshots").withColumn("_at", F.unix_micros("collection_time"))
    samples.write.partitionBy("_at").parquet(f"{root}/samples")
    stored = v.spark.read.schema(samples.schema).parquet(f"{root}/samples")
    return stored, sorted(r[0] for r in stored.select("_at").distinct().collect())


@query("stream_cpu_history", "WITH " + batch._CPU_SQL + "SELECT * FROM fresh")
def _(v):
    records, root = _streamed(v, "fx_cpu", "cpu_records")
    out = stream_cpu_history(records, v("fx_clock"))
    write_available(out, f"{root}/out", f"{root}/checkpoint")
    return v.spark.read.schema(out.schema).parquet(f"{root}/out")


@query("stream_alerts", batch._alert_sql("fx_errors") + "SELECT * FROM fired")
def _(v):
    errors = v("fx_errors").withColumn("collection_time", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    root = scratch_path(v.spark, "stream-errors")
    append_history(errors, f"{root}/error_events", TELEMETRY["error_events"], "collection_time")
    alert_batches(stream_telemetry(v.spark, root, "error_events"), f"{root}/out", f"{root}/state", f"{root}/checkpoint")
    return v.spark.read.parquet(f"{root}/out").select("server_id", "rule", "event_id", "event_time")


@query("stream_alert_batches", batch._alert_sql("fx_storm") + "SELECT * FROM fired")
def _(v):
    root = scratch_path(v.spark, "stream-storm")
    # Two days of the storm arrive as two micro-batches, in order.
    half = F.col("event_time") < F.lit("2024-01-01 14:00:00").cast("timestamp")
    for part in (half, ~half):
        v("fx_storm").filter(part).coalesce(1).write.mode("append").parquet(f"{root}/events")
    schema = v("fx_storm").schema
    stream = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    alert_batches(stream, f"{root}/out", f"{root}/state", f"{root}/checkpoint")
    return v.spark.read.parquet(f"{root}/out").select("server_id", "rule", "event_id", "event_time")


@query("stream_cpu_history_stored", "WITH " + batch._CPU_SQL + "SELECT * FROM unseen")
def _(v):
    records, root = _streamed(v, "fx_cpu", "cpu_records")
    out = stream_cpu_history(records, v("fx_clock"), v("fx_cpu_history"))
    write_available(out, f"{root}/out", f"{root}/checkpoint")
    return v.spark.read.schema(out.schema).parquet(f"{root}/out").select("server_id", "record_id", "event_time", "sql_process", "system_idle", "other_process", "collection_time")


@query("stream_session_deltas", "WITH " + _PAIRS_SQL + "SELECT server_id, collection_time, session_id, request_id, " + ", ".join(
    f"CASE WHEN ok AND d{i} >= 0 THEN d{i} END AS {m}_delta" for i, m in enumerate(deltas.METRICS, start=1)
) + f", {_DELTA_CPU} FROM pairs")
def _(v):
    root = scratch_path(v.spark, "stream-snapshots")
    # Each collection arrives as a micro-batch of its own, in order of time; the polls are not evenly spaced.
    samples, times = _by_collection(v, root)
    for at in times:
        _arrive(samples.filter(F.col("_at") == at).drop("_at"), f"{root}/in", lambda stream: delta_batches(stream, f"{root}/out", f"{root}/state", f"{root}/checkpoint"))
    return v.spark.read.parquet(f"{root}/out").select(*SK, *[f"{m}_delta" for m in deltas.METRICS], "cpu_delta")


@query("stream_session_deltas_shuffled", "WITH " + _PAIRS_SQL + "SELECT server_id, collection_time, session_id, request_id, " + ", ".join(
    f"CASE WHEN ok AND d{i} >= 0 THEN d{i} END AS {m}_delta" for i, m in enumerate(deltas.METRICS, start=1)
) + f", {_DELTA_CPU} FROM pairs")
def _(v):
    root = scratch_path(v.spark, "stream-shuffled")
    # The collections arrive newest first, then the oldest: each gets or corrects its neighbours later.
    samples, times = _by_collection(v, root)
    late = timedelta(microseconds=times[-1] - times[0])
    for at in [*times[::-2], *times[-2::-2][::-1]]:
        _arrive(samples.filter(F.col("_at") == at).drop("_at"), f"{root}/in", lambda stream: delta_batches(stream, f"{root}/out", f"{root}/state", f"{root}/checkpoint", lateness=late))
    return read_deltas(v.spark, f"{root}/out").select(*SK, *[f"{m}_delta" for m in deltas.METRICS], "cpu_delta")


@query("stream_drift_parts", "WITH " + batch._DRIFT_SQL + "SELECT side, server_id AS secondary_id, * EXCLUDE (side, server_id) FROM drift")
def _(v):
    root = scratch_path(v.spark, "stream-drift-parts")
    primary = freeze(batch._definitions(v))
    arriving = batch._changed(primary).withColumnRenamed("server_id", "secondary_id")
    reference = primary.withColumnRenamed("server_id", "secondary_id")
    # Steps of one job arrive in different batches.
    for part in range(3):
        _arrive(
            arriving.filter(F.coalesce("step_no", F.lit(0)) % 3 == part), f"{root}/definitions",
            lambda stream: stream_drift_parts(stream, reference, f"{root}/out", f"{root}/state", f"{root}/checkpoint"),
        )
    columns = ["side", "secondary_id", *jobs.COMPARED, "has_command"]
    return read_drift(v.spark, f"{root}/out").select(*columns).withColumn("secondary_id", F.col("secondary_id").cast("bigint"))


@query("stream_drift", "WITH " + batch._DRIFT_SQL + "SELECT side, server_id AS secondary_id, * EXCLUDE (side, server_id) FROM drift")
def _(v):
    root = scratch_path(v.spark, "stream-drift")
    primary = freeze(batch._definitions(v))
    arriving = batch._changed(primary).withColumnRenamed("server_id", "secondary_id")
    arriving.write.parquet(f"{root}/definitions")
    stream = v.spark.readStream.schema(arriving.schema).parquet(f"{root}/definitions")
    stream_drift(stream, primary.withColumnRenamed("server_id", "secondary_id"), f"{root}/out", f"{root}/checkpoint")
    columns = ["side", "secondary_id", *jobs.COMPARED, "has_command"]
    return v.spark.read.parquet(f"{root}/out").select(*columns)
