"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload.queries import registered  # noqa: E402

HEADLINES = (
    "scan",
    "monthly_summary",
    "procedure_summary",
    "volume_flags",
    "revenue_flags",
    "spike_flags",
    "consistency_flags",
    "nos_flags",
    "upcoding_flags",
    "peer_comparisons",
    "procedure_monthly",
    "dossier",
    "region_subset",
)

# Not timed. A JVM just started spends most of a short query compiling.
WARM_UP = ("dossier", "region_subset", "scan")


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimgauge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()

    tracker = spark.sparkContext.statusTracker()
    jobs: dict[str, int] = {}

    def timed(name: str) -> float:
        spark.sparkContext.setJobGroup(name, name)
        before = len(tracker.getJobIdsForGroup(name))
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - started
        jobs[name] = len(tracker.getJobIdsForGroup(name)) - before
        return round(seconds, 3)

    for name in WARM_UP:
        timed(name)
    seconds = {name: timed(name) for name in HEADLINES}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "warm_up": list(WARM_UP),
        "queries": seconds,
        "jobs": {name: jobs[name] for name in HEADLINES},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
