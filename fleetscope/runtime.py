"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fleetscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster leave ``master`` unset and size shuffles through AQE:
    start high and let it coalesce. ``forceOptimizeSkewedJoin`` keeps the
    skew split even where it costs one more exchange, because one server may
    own a third of the rows.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is set, a session that runs in one process (tests, a laptop) gets a folder of
    its own; a cluster gets an error, because each machine would write to its own disk.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and freezes the rows.

    Used between rounds of an iterative operator so the plan stays flat. The checkpoint
    would also hand on its size estimate, the product of the sizes joined so far: over many
    rounds a number of millions of digits. One beyond all sense is dropped for Spark's default.
    """
    root = checkpoint_root(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return _sensibly_sized(df.checkpoint(eager=True))


def freeze(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: compressed, read by column, with a true size.

    For wide tables that are read more than once; loops with many rounds use ``cut_lineage``,
    whose files go when nothing refers to them any more.
    """
    path = scratch_path(df.sparkSession, "frozen")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freeze_dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``freeze`` in buckets by ``keys``: what is grouped by these and any more keys later does not move again.

    Keys are stored under other names: a column that is read as it is carries the name of its
    table, and Spark then does not see that two such tables in a union are dealt alike.
    """
    spark = df.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"dealt_{uuid.uuid4().hex}"
    stored = {k: f"_dealt_{k}" for k in keys}
    rows = df.withColumnsRenamed(stored).repartition(buckets, *stored.values())
    rows.write.bucketBy(buckets, *stored.values()).option("path", scratch_path(spark, "dealt")).saveAsTable(name)
    return spark.table(name).withColumnsRenamed({v: k for k, v in stored.items()})


def _sensibly_sized(frozen: DataFrame) -> DataFrame:
    plan = frozen._jdf.queryExecution()
    if plan.analyzed().stats().sizeInBytes() < 1 << 62:
        return frozen
    spark = frozen.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), frozen._jdf.schema(), False), spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables a job writes and reads back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
