"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with the per-query wall time.

Each query is executed in full with the ``noop`` sink (no collect to the
driver).  A short warm-up on the smallest scale factor runs first so JVM
start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from trackframe.plans.queries import REGISTRY
    from trackframe.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", cpus)),
                          memory=os.environ.get("BENCH_MEMORY", "6g"), app="trackframe-bench")
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        REGISTRY["physics_baseline"](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in REGISTRY.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # keep going; report the failure
            failed[name] = str(exc)[:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": int(cpus),
    }
    if failed:
        out["failed"] = failed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
