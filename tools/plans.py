"""List plan shapes that would hurt at scale: python tools/plans.py SF_DIR [key ...]"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import local_session  # noqa: E402

SHAPES = {"cross": r"CartesianProduct|BroadcastNestedLoopJoin", "single": r"Exchange SinglePartition", "scans": r"Scan parquet|Scan ExistingRDD", "shuffles": r"Exchange hashpartitioning",
          "windows": r"\+- Window|:- Window|Window \[", "python": r"MapInArrow|MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython", "sorts": r"Sort \["}


def main():
    sf, keys = sys.argv[1], sys.argv[2:]
    from pulsegrid.plans import QUERIES
    spark = local_session("plans")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", os.environ.get("BROADCAST", "10MB"))
    for k in keys or QUERIES:
        plan = QUERIES[k](spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {n: len(re.findall(p, plan)) for n, p in SHAPES.items()}
        flag = "CROSS " if counts["cross"] else ""
        print(f"{k:32s} {flag}" + " ".join(f"{n}={c}" for n, c in counts.items() if c), flush=True)


if __name__ == "__main__":
    main()
