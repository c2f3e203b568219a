"""Benchmark: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. ``value`` is the sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave.plans import registry  # noqa: E402
from panelweave.session import local_session  # noqa: E402

HEADLINE = (
    "person_cycle_panel", "win_loo_mean", "jn_tiered_fuzzy", "lnk_candidates", "val_threshold_sweep", "lnk_insiders",
    "agg_spell", "jn_range", "agg_box", "agg_mean_ci", "agg_density", "smp_reservoir", "win_running_group",
    "mdl_ols", "mdl_lmm_ri", "mdl_lmm_rs", "src_typed_project", "study_panel",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus))
    queries, _ = registry.load()
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    out = {
        "metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
