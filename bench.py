"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=4 python bench.py

Each query is run once to warm up, then ``BENCH_REPS`` (default 3) times;
the median wall time of a full execution (``noop`` sink, every row produced,
nothing collected) is reported per query. ``value`` is the sum of medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from equiscope.plans.registry import load_all  # noqa: E402
from equiscope.session import local_session  # noqa: E402

HEADLINE = {
    "group_metrics": "group_metrics_gender",
    "audit_cube": "audit_cube",
    "demographic_parity": "demographic_parity",
    "equalized_odds": "equalized_odds_gender",
    "drift_report": "drift_report_stats",
    "conformal_quantile": "conformal_quantile",
    "similar_profiles": "similar_profiles",
    "linear_attribution": "linear_attribution",
}


def run_once(spark, q, sf_dir):
    t = time.perf_counter()
    q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "4")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cpus=cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 8),
                          app="equiscope-bench")
    qs = load_all()
    out = {}
    for label, name in HEADLINE.items():
        q = qs[name]
        run_once(spark, q, sf_dir)  # warm-up
        out[label] = round(statistics.median(run_once(spark, q, sf_dir) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": sf, "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
