"""Print the physical-plan operators that matter for scale for a few queries:
scans with their pushed filters and read schemas, exchanges, partial top-k
limits and join strategies.

usage: python scripts/show_plans.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codehealth.plans.catalog import QUERIES  # noqa: E402
from codehealth.session import get_spark  # noqa: E402

SHOWN = ["t1_top_complexity", "a10_tree_rollup", "t5_file_hotspots", "c5_clones", "c11_unused_exports",
         "w7_every_nth_commits", "c17_churn"]
KEEP = re.compile(r"(Scan parquet|PushedFilters|ReadSchema|Exchange|WindowGroupLimit|HashJoin|SortMergeJoin|"
                  r"HashAggregate|Generate|Window \(|TakeOrdered|InMemoryRelation|Scan ExistingRDD)")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    print("# Physical plans (excerpts)\n")
    print(f"Generated by `scripts/show_plans.py {sf}`: the operators that decide scale behaviour.\n")
    for name in SHOWN:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [ln.rstrip() for ln in plan.splitlines() if KEEP.search(ln)]
        print(f"## {name}\n\n```")
        for ln in lines:
            print(ln[:220])
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
