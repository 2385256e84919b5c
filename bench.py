"""Times the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then RUNS times with its full output written to the `noop` sink;
the best time counts. Streams, whose work is done while they are started, run once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from panewise.plans.registry import QUERIES
from panewise.session import local_session

RUNS = 2


def timed(spark, run, sf_dir: str) -> float:
    begin = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, app="panewise-bench")
    seconds = {}
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        if "stream" in name:
            seconds[name] = timed(spark, query.run, sf_dir)
        else:
            timed(spark, query.run, sf_dir)
            seconds[name] = min(timed(spark, query.run, sf_dir) for _ in range(RUNS))
    spark.stop()
    result = {
        "metric": "all registered queries, best of runs, output to noop",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
