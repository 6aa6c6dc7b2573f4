"""Static physical-plan summary of every registered query.

    python tools/plan_report.py [sf_dir]

Plans are taken with AQE off and automatic broadcasts off, i.e. the shape the
plan has when no input is small: hash exchanges (shuffles) and the keys they
hash on, explicit broadcasts of one-row tables, Python evaluation nodes and
cartesian products.  Prints a Markdown table.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(plan: str) -> dict:
    keys = Counter()
    for m in re.finditer(r"Exchange hashpartitioning\(([^)]*)\)", plan):
        cols = [re.sub(r"#\d+L?", "", c.strip()) for c in m.group(1).split(",")]
        keys[",".join(c for c in cols if not c.isdigit())] += 1
    return {
        "shuffles": sum(keys.values()),
        "keys": "; ".join(f"{k} x{n}" if n > 1 else k for k, n in keys.items()),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": sum(plan.count(k) for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                                                "FlatMapGroupsInPandas")),
        "cartesian": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
        "single_partition": plan.count("SinglePartition"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from trackframe.plans.queries import REGISTRY
    from trackframe.session import local_session

    spark = local_session(cores=4, shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    print("| query | shuffles | hash keys | broadcasts | python nodes | cartesian | single-partition |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in REGISTRY.items():
        if name.startswith("stream_") or name in ("gbt_predict", "feature_importance"):
            continue  # their plans are per micro-batch / inside Spark ML
        s = summarize(fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['shuffles']} | {s['keys']} | {s['broadcasts']} | {s['python']} | "
              f"{s['cartesian']} | {s['single_partition']} |")
    spark.stop()


if __name__ == "__main__":
    main()
