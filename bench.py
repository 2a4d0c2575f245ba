"""Time the headline queries on one machine; prints one JSON line.

Each query runs once to warm up and is then timed over whole tables, every row
and column computed. The best of ``BENCH_REPEATS`` runs counts.
"""

from __future__ import annotations

import json
import os
import time

from runlens.session import local_session
from runlens.workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

# Building a query should not pay for noting each column's line of code.
CONF = {"spark.sql.dataFrameQueryContext.enabled": "false"}

HEADLINE = [
    "stats",
    "flake_rate",
    "breakdown",
    "heatmap",
    "top_flakes",
    "devices",
    "by_action",
    "by_platform",
    "volume",
    "duration_dist",
    "class_trend",
    "sessions",
    "latest_session",
    "latest_session_tests",
    "rolling7",
    "heat_matrix",
    "screen_of",
    "rule_classify",
    "last_actions_n",
    "merge_new_runs",
    "read_runs",
    "runs_table",
    "classify_batch",
    "report_bundle",
    "stream_last_actions",
    "stream_ingest",
]


def seconds(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(cpus=CPUS, app="runlens-bench", **CONF)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, name)
        times[name] = round(min(seconds(spark, name) for _ in range(REPEATS)), 3)
    spark.stop()
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
