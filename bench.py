"""Benchmark the registered queries.

Runs every query (or those named on the command line) at ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON
line.  Each query is executed to completion through the ``noop`` sink, so the
whole plan runs without pulling rows to the driver; one warm-up query runs
first so JVM start-up is not charged to a query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailguard.plans.registry import load_all  # noqa: E402
from mailguard.session import build_session  # noqa: E402

# Model-selection jobs whose time is dominated by iterative solvers (one Spark
# job per iteration, dozens of fits); run them with ``bench.py --ml``.
SOLVER_BOUND = {"base_classifier_cv", "stack_four_way", "stack_final_estimators",
                "hyperparameter_search", "recursive_feature_elimination", "gbt_feature_importances",
                "lr_coefficients", "lda_topics", "kmeans_elbow", "count_and_hash_vectors",
                "stream_scoring"}


def main(argv: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), conf={"spark.driver.memory": "16g"})
    reg = load_all()
    ml = "--ml" in argv
    names = [n for n in argv if n in reg] or [n for n in reg if ml or n not in SOLVER_BOUND]
    # JVM/JIT warm-up on the smallest data set, not charged to any query
    reg["dmarc_target_summary"].build(spark, "/root/testdata/sf0.001").write.format("noop") \
        .mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e).splitlines()[0][:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}
    if failed:
        out["failed"] = failed
    skipped = sorted(set(reg) - set(names))
    if skipped:
        out["not_run"] = skipped
    print(json.dumps(out))


if __name__ == "__main__":
    main(sys.argv[1:])
