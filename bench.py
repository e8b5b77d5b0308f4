"""Wall-clock of the headline queries: one JSON line on stdout."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid.plans import QUERIES  # noqa: E402
from pulsegrid.session import local_session  # noqa: E402

HEADLINE = ["quality_status_window", "bounded_resample", "event_mask_join", "cuff_preceding_interval", "method_chrom", "method_chrom_win", "window_priors",
            "hr_welch", "lag_aligned_metrics", "delay_gate", "coverage_metrics", "subject_balanced_metrics", "subject_bootstrap_ci", "optical_descriptors",
            "rank_windows", "segment_signal", "loso_ridge", "job_classical_benchmark", "job_bp_table", "stream_window_quality",
            "job_classical_study"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/region.parquet").count()      # start the executors before timing
    times = {}
    for name in only or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
