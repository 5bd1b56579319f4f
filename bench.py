"""Time the headline queries: ``BENCH_SF_DIR=... BENCH_CPUS=... python bench.py [--all]``.

Each query runs once to warm up and three times for the median; results are fully computed
(every row and column) by Spark's no-op writer. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from packetlens.plans.all_queries import CATALOG
from packetlens.plans.views import view
from packetlens.session import local_session

HEADLINE = [
    "top_conversations",
    "flows",
    "timeline_hourly",
    "overview",
    "beacons",
    "scan_horizontal",
    "scan_rapid",
    "large_transfers",
    "high_outbound_ratio",
    "dns_tunnels",
    "dns_stats",
    "findings",
    "selected_indicators",
    "indicator_priority_capped",
    "cascade",
    "text_ips",
]


def run_once(plan, spark, sf_dir) -> float:
    start = time.perf_counter()
    plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = [n for n in sys.argv[1:] if not n.startswith("-")]
    wanted = list(CATALOG) if "--all" in sys.argv else chosen or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in wanted:
        plan = CATALOG[name].plan
        cold = run_once(plan, spark, sf_dir)
        seconds[name] = round(statistics.median(run_once(plan, spark, sf_dir) for _ in range(repeats)), 3)
        if "-v" in sys.argv:
            print(name, round(cold, 2), seconds[name], file=sys.stderr, flush=True)
    packets = view(spark, sf_dir, "traffic_v").count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "packets": packets,
                "packets_per_second": {
                    n: round(packets / seconds[n]) for n in ("top_conversations", "flows", "timeline_hourly") if n in seconds
                },
            }
        )
    )


if __name__ == "__main__":
    main()
