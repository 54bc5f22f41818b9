"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
  {"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

``prepare_tables`` is the batch job itself (bronze analog from the test tables,
then silver and both gold tables written as Parquet); the read-side queries then
scan those tables, as the dashboard does. Each query runs to completion through
the ``noop`` sink (every row computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from carepulse.plans import catalog  # noqa: E402
from carepulse.session import local_session  # noqa: E402


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=2 * cpus, app="carepulse-bench")
    spark.sparkContext.setLogLevel("ERROR")

    # Warm-up: one untimed pass of every query on the smallest scale, so the timed
    # pass measures the work at $BENCH_SF_DIR rather than one-off JVM costs
    # (class loading, generated-code compilation, JIT) that do not grow with data.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm_dir and os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        catalog.prepared(spark, warm_dir)
        for fn in catalog.QUERIES.values():
            fn(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    catalog.prepared(spark, sf_dir)
    times["prepare_tables"] = round(time.perf_counter() - t0, 3)

    for name, fn in catalog.QUERIES.items():
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": _sf(sf_dir),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
