"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Every query is fully executed through the ``noop`` sink (no rows to the
driver); fitted models are not shared between queries, so each timing includes
its own fits. Each query first runs once, untimed, on the sf0.001 tables to warm
the JVM (JIT, code caches); nothing computed there is reused.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "evaluate_segments",      # flagship: split, standardise, ridge fit, score, segment metrics + p-value
    "profile_numeric",        # moments + exact distributed medians, 8 columns
    "grouped_profile",        # the same per (returnflag, linestatus)
    "unique_ratio",           # exact distinct ratios incl. long text
    "missing_by_column",      # quality aggregate
    "histogram_30",           # chart data, 4 columns
    "predict",                # batch scoring
    "score_guard",            # unseen-category guard (left-anti join)
    "permute_column",         # bucketed global ranks + join
    "permutation_importance",  # 10 shuffles, one scoring job
    "grid_search",            # 3-fold CV over the ridge grid
    "random_forest",          # 100 trees depth 8, test metrics
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from estima.plans import frames
    from estima.plans.catalog import QUERIES
    from estima.session import build_session
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # untimed warm-up on the smallest tables (JIT / code caches); no result or
    # model is reused by the timed runs
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for n in names:
        if os.path.isdir(warm_dir):
            frames._MODELS.clear()
            QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    frames._MODELS.clear()
    times = {}
    for n in names:
        frames._MODELS.clear()
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
