"""Benchmark of the headline queries.

Runs each query on $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS]; one
warm-up run, then the median of $BENCH_RUNS timed runs of a full materialisation (a no-op
write of every row).  A query whose warm-up takes over $BENCH_LONG_SEC seconds (SVM training)
gets one timed run; "runs" in the output says how many each query had.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["build_dictionary", "vectors", "serving_vectors", "score_writeback", "kmeans",
            "svm_train_eval", "trend_words", "lemmatise"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    from polarity.queries import load_all
    from polarity.session import build_session
    spark = build_session(f"local[{cpus}]", max(cpus, 8))
    q, _ = load_all()
    long_sec = float(os.environ.get("BENCH_LONG_SEC", "60"))
    times, counts = {}, {}
    for name in names:
        def run():
            t0 = time.time()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.time() - t0
        warm = run()
        n = 1 if warm > long_sec else runs
        times[name] = round(statistics.median(run() for _ in range(n)), 3)
        counts[name] = n
        print(f"# {name}: {times[name]}s (warm-up {warm:.1f}s, {n} runs)", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else None,
                      "cpus": cpus, "runs": counts}))


if __name__ == "__main__":
    main()
