"""Benchmark: headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job is executed to completion with the no-op sink (no driver collect), in the
order a user runs them: ingest once, then the scorers, fusion, evaluation, the
full train → tune → evaluate flow and the streaming replay. ``value`` is the sum.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "bias_topn", "content_topn", "context_rerank", "fused_topn", "fusion_grid",
    "evaluate_models", "explain_sentence", "validation_checks", "svd_topn",
    "neural_training", "hybrid_tuning", "evaluate_all", "ema_replay", "stream_windows",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in sys.argv[1:]]
    from rankloom.plans import catalog
    from rankloom.plans.pipeline import prepare_retail
    from rankloom.session import build_session

    spark = build_session(master=f"local[{cpus}]")
    times = {}
    t0 = time.time()
    p = prepare_retail(spark, sf_dir)
    p.ratings.write.format("noop").mode("overwrite").save()
    times["ingest"] = round(time.time() - t0, 3)
    for name in (only or HEADLINE):
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": m.group(1) if m else sf_dir,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
