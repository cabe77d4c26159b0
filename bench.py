"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]. Prints one JSON line.

Each query is fully executed (``df.write.format("noop")``) so the timing
covers the whole plan without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.plans.catalog import QUERIES  # noqa: E402
from fleetlens.session import get_session  # noqa: E402

HEADLINE = [
    "snapshot_diff", "rename_pairs", "impact_report", "change_report", "document_mentions", "state_upsert",
    "stale_state", "conflicts", "core_edges", "boundary_matrix", "cyclic_components", "bounded_cycles", "witness_cycles",
    "health", "verdict", "doc_vs_actual", "removed_exports", "broken_links", "copied_blocks", "line_rules",
    "status_rollup", "check_tally", "sessions", "sessions_stream",
    "cycle_modules", "new_findings", "batch_items", "sync_stream", "copied_ranges", "folder_sizes", "ordered_names",
    "config_defaults", "project_status", "project_checks",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or (HEADLINE if os.environ.get("BENCH_ALL") != "1" else list(QUERIES))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=parts, app_name="fleetlens-bench")
    # warm the JVM and the parquet footers once so the first query is not charged for it
    QUERIES["snapshot_diff"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
