"""Headline queries, median seconds of three runs after a warm-up; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vecflow.catalog import QUERIES
from vecflow.session import local_session

HEADLINES = [
    "k01_exact_cosine",  # exact top-15 of the held-out vectors
    "k01_supplier_lines",  # exact top-15 of every supplier's mean among all line items
    "w1_top_k_all",  # every vector against all others
    "k06_validity",
    "k13_scalar_quantised",
    "k12_ivf_probes",
    "e06_folds",
    "e08_shared_grid",
    "a10_iqr_mean_by_user",
    "a10_iqr_mean_25",
    "r1_grouped_holdout",
    "a13_correlations",
    "w2_changed_scores",
    "p15_parameter_literal",
    "j1_prefix_join",
    "f07_mfcc",
]
RUNS = 3


def seconds(run, spark, folder: str) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    found = {}
    for name in HEADLINES:
        seconds(QUERIES[name], spark, folder)
        found[name] = round(statistics.median(seconds(QUERIES[name], spark, folder) for _ in range(RUNS)), 3)
    total = round(sum(found.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": found, "sf": sf}))


if __name__ == "__main__":
    main()
