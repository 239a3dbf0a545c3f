"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default all)
BENCH_RUNS     timed runs per query after one warm-up run (default 3, their median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyscope.plans import registry  # noqa: E402
from tallyscope.session import get_session  # noqa: E402

HEADLINE = (
    "duplicate_rows",
    "missing_summary",
    "kpi_overview",
    "column_stats_business",
    "readiness",
    "grouped_comparison",
    "grouped_comparison_by_region",
    "ranked_groups",
    "diagnostic_findings",
    "margin_flags",
    "trend_summary",
    "trend_by_dimension",
    "forecast_projection",
    "forecast_projection_by_nation",
    "recommendations_by_region",
    "narrative_sections",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus,
    }
    spark = get_session("bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
