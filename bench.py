"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (folder of tables), BENCH_CPUS (local threads), BENCH_QUERIES
(comma-separated names). Each query is planned and run in full once, after a warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import time

from sourcegauge.plans.registered import REGISTERED
from sourcegauge.session import local_session

HEADLINE = (
    "report_direct_metrics", "report_outbound_link", "report_full", "classify_actions", "classify_reasons",
    "rollup_placement", "rollup_overall", "mode_call", "selection_compare_groups", "revenue_share_in_vertical", "locate_page",
    "anomalies", "peer_percentiles", "opportunity_matrix", "cohort_intelligence", "portfolio_health", "what_if",
    "overall_insights", "history_search", "export_view",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "bench")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    seconds("classify_actions")
    times = {name: seconds(name) for name in names}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus) if cpus.isdigit() else cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
