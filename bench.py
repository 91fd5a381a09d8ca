"""Benchmark the headline queries.

Runs each query end to end (full plan executed through the no-op sink, no
collect) at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS], after one untimed warm-up; each query's time is the median
of $BENCH_REPEATS (default 3) runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codehealth.plans import materialize  # noqa: E402
from codehealth.plans.catalog import QUERIES  # noqa: E402
from codehealth.session import checkpoint_dir, get_spark  # noqa: E402

HEADLINE = [
    ("language_overview", "a1_language_overview"),
    ("top_complexity", "t1_top_complexity"),
    ("tree_rollup", "a10_tree_rollup"),
    ("file_hotspots", "t5_file_hotspots"),
    ("health_trend", "a14_health_trend"),
    ("clones", "c5_clones"),
    ("unused_exports", "c11_unused_exports"),
    ("churn", "c17_churn"),
    ("reachability", "g7_reachable"),
    ("circular_edges", "g1_circular_edges"),
]


def _shuffle_written(spark) -> int:
    """Total shuffle bytes written so far (executor summaries of the status store)."""
    try:
        sc = spark.sparkContext._jsc.sc()
    except Exception:  # noqa: BLE001
        return -1
    try:
        sc.listenerBus().waitUntilEmpty()
    except Exception:  # noqa: BLE001 - best effort; counters may lag slightly
        time.sleep(0.5)
    try:
        ex = sc.statusStore().executorList(False)
        return sum(ex.apply(i).totalShuffleWrite() for i in range(ex.size()))
    except Exception:  # noqa: BLE001 - metrics are informative; never fail the bench on them
        return -1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", app="codehealth-bench",
                      shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    checkpoint_dir(spark)
    # warm-up: JIT and file listing, not timed
    QUERIES["a1_overview_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeats = max(1, int(os.environ.get("BENCH_REPEATS", "3")))
    times, shuffled = {}, {}
    for label, name in HEADLINE:
        runs = []
        for _ in range(repeats):
            materialize.clear()  # each timed run pays for every table it needs
            before = _shuffle_written(spark)
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            shuffled[label] = max(shuffled.get(label, 0), _shuffle_written(spark) - before)
        times[label] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "shuffle_write_bytes": shuffled}))
    spark.stop()


if __name__ == "__main__":
    main()
