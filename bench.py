"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
threads. Each query runs once to warm up and then BENCH_RUNS times (default 1); the median
counts. Results are written to the no-op sink, so every row is computed and none is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetscope.runtime import build_session  # noqa: E402
from harness import QUERIES  # noqa: E402

HEADLINES = [
    "blocking_chains", "blocker_closure", "session_rollup", "primary_wait", "session_request_join", "wait_profile",
    "lock_inventory", "resolve_object_names", "lock_document", "session_deltas", "tempdb_usage", "transaction_log_usage",
    "cpu_history", "job_definition_view", "definition_drift", "space_tracking", "unsynced_databases", "alert_events",
    "resolve_selection", "backup_plan", "integrity_plan", "index_plan", "command_report", "report_document",
    "session_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "fleet_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
