"""Times the headline queries; prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the local threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, ROOT)

HEADLINE = (
    "class_counts", "dup_weight", "conflict_mask", "dataset_fingerprint", "rank_within_class", "signal_quantiles", "signal_corr", "class_prototypes", "oof_signal", "loo_prototype",
    "mutual_knn_signal", "q0_full", "hamming_pairs", "near_dup_components", "split_quota",
)
RUNS = 3  # timed, after one that is not


def main() -> None:
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from lodeflow.queries import QUERIES
    from lodeflow.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", 8)
    spark.sparkContext.setLogLevel("OFF")
    took, rows = {}, {}
    for name in HEADLINE:
        seen = Observation()  # the first run compiles and counts
        QUERIES[name](spark, sf).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        rows[name] = seen.get["n"]
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(median(times), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows": rows, "runs": RUNS, "sf": sf}))


if __name__ == "__main__":
    main()
