"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once cold and three times warm; the median of the warm runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from keystead.plans import QUERIES
from keystead.session import build_session

HEADLINE = (
    "top_undervalued", "A01_comp_statistics", "J01_search_match", "J03_permit_proximity", "J06_register_match",
    "J12_similar_listings", "W01_price_change_events", "W03_rate_limit", "M12_score_all", "T02_dispatch_batch",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_WARM", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times, cold, rows = {}, {}, {}
    for name in names:
        runs = []
        for i in range(warm + 1):
            t = time.perf_counter()
            # all rows and columns are computed, none are kept
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        cold[name] = round(runs[0], 3)
        times[name] = round(statistics.median(runs[1:] or runs), 3)
        print(f"{name}: cold {cold[name]}, warm {times[name]}", file=sys.stderr, flush=True)
    for t in ("lineitem", "orders", "customer", "part", "events"):
        rows[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "rows": rows,
        "cores": int(cpus), "memory": "16g", "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
