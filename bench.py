"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from distinctspark.session import build_session  # noqa: E402
from distinctspark.workloads.queries import QUERIES  # noqa: E402

HEADLINE = (
    "exact_distinct",
    "loglog",
    "adaptive_counting",
    "hyperloglog",
    "hllpp_sparse",
    "hllpp_builtin",
    "hll_sketch_native",
    "theta_native",
    "linear_counting",
    "linear_counting_1pct",
    "flajolet_martin",
    "kmv",
    "bloom_swamidass",
    "bloom_semi_filter",
    "bjkst",
    "count_then_estimate",
    "merge_hll",
    "kmv_set_overlap",
    "sliding_direct",
    "sliding_sliced",
    "sliding_exact",
    "novelty_flag",
    "latency_summary",
    "throughput_cdf",
    "accuracy_report",
    "stream_sliced_append",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hyperloglog"](spark, folder).collect()  # start the JVM's compilers
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
