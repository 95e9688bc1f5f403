"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query result is fully materialised (written to a no-op sink via ``count``
on the final plan) and timed after one warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee.plans.queries import QUERIES  # noqa: E402
from marquee.session import get_session  # noqa: E402

HEADLINE = [
    "territory_summary",       # flagship: full linkage + feature master + aggregate
    "feature_master",
    "resolve_entities",
    "candidate_universe",
    "describe_all",
    "num_summary_lineitem",
    "corr_matrix_lineitem",
    "missing_counts",
    "histogram",
    "month_box",
    "impute",
    "outliers_filter",
    "dedup_most_complete",
    "one_hot",
    "target_encode",
    "scale_standard",
    "regression_metrics",
    "ensemble_weighted",
    "train_models",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = get_session(f"local[{cpus}]", int(cpus) * 2)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    # warm-up: JIT + catalogue of the parquet footers
    QUERIES["shape"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
