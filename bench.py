"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (all rows are
computed, nothing is collected).  Times are the median of $BENCH_RUNS runs
after one warm-up run of the whole set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["exact_title_lookup", "postings_build", "body_terms_match", "article_medium", "search_rendered"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    warm = os.environ.get("BENCH_WARMUP", "1") == "1"
    from quire.plans import registry
    from quire.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    if warm:
        run("exact_title_lookup")
    times = {}
    for name in HEADLINE:
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
