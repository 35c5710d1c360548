"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the sample tables, ``BENCH_CPUS`` the local cores, ``BENCH_ROUNDS``
how often each query runs (the fastest counts). Results go to the noop sink, so every row
is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from fleetwright.session import local_session  # noqa: E402

HEADLINE = [
    "definitions_normalized",
    "definitions_quarantine",
    "stream_open_request",
    "lifecycle_plan",
    "lifecycle_events",
    "configuration_drift",
    "orphan_runs",
    "missing_templates",
    "run_parameters",
    "phase_transitions",
    "time_in_phase",
    "latest_state",
    "run_census",
    "heartbeat_counts",
    "heartbeat_windows",
    "event_to_owner",
    "backfill_load",
    "backfill_handoff",
    "gap_fill",
    "change_capture",
    "stream_phase_tracker",
    "streaming_heartbeats",
]


def run_once(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run_once(spark, "phase_census", folder)
    times = {name: round(min(run_once(spark, name, folder) for _ in range(rounds)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
