"""Time every registered query: one JSON line on stdout.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the median counts (default 3)

Marts the reports read are built once before the runs and timed apart (``mart_build``); the mart jobs
themselves are the ``m*`` queries and run in full every time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = ["raw", "events", "sessions", "session_modes", "daily", "retention", "user_flags", "devices"]


def main() -> None:
    from checks.registry import QUERIES
    from checks.store import TestMarts
    from tidemark import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    builds = {}
    marts = TestMarts(spark, sf_dir)
    for name in TABLES:
        start = time.perf_counter()
        getattr(marts, name)
        builds[name] = round(time.perf_counter() - start, 3)

    seconds = {}
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "mart_build": builds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
