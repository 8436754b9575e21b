"""Severity and error alerts with a cooldown per server and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetscope.operators.graph import reachable
from fleetscope.operators.ranking import best_row
from fleetscope.runtime import cut_lineage
from fleetscope.sources.telemetry import inline_relation

# Alert rules and the seconds between two responses of one rule.
COOLDOWN_SECONDS = 60
SEVERITY_RULES = range(16, 26)
ERROR_RULES = (823, 824, 825)

_KEY = ["server_id", "rule"]


def alert_rules(spark: SparkSession) -> DataFrame:
    """Thirteen rules: one per severity from 16 to 25, three for single error numbers."""
    rows = [(f"Severity {s:03d}", s, None) for s in SEVERITY_RULES]
    rows += [(f"Error Number {e}", None, e) for e in ERROR_RULES]
    return inline_relation(spark, rows, "rule string, severity bigint, error_number bigint")


def match_rules(events: DataFrame) -> DataFrame:
    """Events with each rule they meet, an exact severity or an exact error number.

    The rules are few and fixed, so they are written as a column rather than joined.
    """
    severity = F.when(
        F.col("severity").between(min(SEVERITY_RULES), max(SEVERITY_RULES)),
        F.concat(F.lit("Severity "), F.lpad(F.col("severity").cast("string"), 3, "0")),
    )
    error = F.when(
        F.col("error_number").isin(*ERROR_RULES), F.concat(F.lit("Error Number "), F.col("error_number").cast("string"))
    )
    return events.withColumn("rule", F.explode(F.array_compact(F.array(severity, error))))


def cooldown_alerts(events: DataFrame, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Alerts that fire: the first event of a rule, then the first at least ``seconds`` after the last fired."""
    return fire_with_cooldown(match_rules(events), seconds)


def fire_with_cooldown(events: DataFrame, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Cooldown over events that already carry their ``rule``.

    Whether an event fires depends on the one fired before it. Time is cut into windows
    as long as the cooldown, and a pause of one cooldown ends a run. A run is never
    gathered: each of its times points to the first time a cooldown later, and the chain
    from the run's start is followed by pointer doubling.
    """
    step = seconds * 1_000_000
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    matched = events.withColumn("_t", micros).withColumn("_w", F.floor(micros / step))
    # Read several times below, and far smaller than the events: written once.
    times = cut_lineage(matched.select(*_KEY, "_w", "_t").distinct())
    windows = times.groupBy(*_KEY, "_w").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    # One row per rule and cooldown window from here on: bounded by the time span.
    in_order = Window.partitionBy(*_KEY).orderBy("_w")
    starts = F.coalesce(F.col("_first") - F.lag("_last").over(in_order) >= step, F.lit(True))
    # Nothing late enough in the next window: the answer is the head of a later one, and heads are in order.
    near = F.lead("_w").over(in_order) >= F.col("_w") + 2
    head = F.when(near, F.lead("_first").over(in_order)).otherwise(F.lead("_first", 2).over(in_order))
    windows = windows.withColumn("_starts", starts).withColumn("_head", head)
    fired = _chain_runs(times.join(windows.select(*_KEY, "_w", "_starts", "_first", "_head"), [*_KEY, "_w"]), step)
    # Events of one instant: the lowest id speaks for them.
    payload = ["event_id", *[c for c in events.columns if c not in (*_KEY, "event_id")]]
    alerts = matched.join(fired, [*_KEY, "_t"])
    return best_row(alerts, [*_KEY, "_t"], [-F.col("event_id")], payload).drop("_t")


def _chain_runs(placed: DataFrame, step: int) -> DataFrame:
    """Fired times by following ``first time a cooldown later`` pointers from the starts of runs."""
    ask = placed.select(*_KEY, (F.col("_w") + 1).alias("_w"), (F.col("_t") + step).alias("_at"), F.col("_t").alias("_from"), "_head")
    none = F.lit(None).cast("bigint")
    have = placed.select(*_KEY, "_w", F.col("_t").alias("_at"), none.alias("_from"), none.alias("_head"))
    # Latest first, so the least time at or after the one asked for is a running minimum.
    after = Window.partitionBy(*_KEY, "_w").orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hops = (
        ask.unionByName(have)
        .withColumn("_next", F.min(F.when(F.col("_from").isNull(), F.col("_at"))).over(after))
        .filter("_from is not null").select(*_KEY, F.col("_from").alias("_t"), F.coalesce("_next", "_head").alias("_next"))
        .filter("_next is not null")
    )
    # Pointers that leave a run lead to the next run's first time, which fires anyway.
    begin = placed.filter(F.col("_starts") & (F.col("_t") == F.col("_first"))).select(*_KEY, "_t")
    return reachable(hops, begin, _KEY, "_t", "_next")
