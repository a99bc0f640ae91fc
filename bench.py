"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palimpsest.catalog import QUERIES  # noqa: E402
from palimpsest.session import local_session  # noqa: E402

HEADLINE = [
    "session_totals", "plan_elide", "plan_structured", "plan_compacted", "plan_scores", "turns", "plan_cliff",
    "qualified_reductions", "session_telemetry", "cohort_summary", "session_report", "requests", "sessions",
    "tools", "metrics_long", "record_search", "snapshot_diff", "prune_plan", "retention", "calibration",
    "activity_windows", "monitor_deltas",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    QUERIES["session_totals"](spark, sf).collect()  # start the JVM's workers before timing
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf,
    }))


if __name__ == "__main__":
    main()
