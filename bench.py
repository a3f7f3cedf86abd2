"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores.
Every query is built and written to a sink that discards rows: one warm-up run,
then the median of BENCH_RUNS (3) runs.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from kicknet.plans.registered import QUERIES
from kicknet.plans.session import local_session

HEADLINES = (
    "score_samples",
    "score_samples_legacy",
    "drop_redundant",
    "assemble_metrics",
    "resolve_rpkc",
    "resolve_dpac",
    "resolve_aptc",
    "rarefy",
    "expand_individuals",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)

    def seconds(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    queries = {}
    for name in HEADLINES:
        seconds(name)
        queries[name] = round(statistics.median(seconds(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
