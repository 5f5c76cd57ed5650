"""Time the headline queries once each, after one warm-up, and print one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names, to time a few
"""

from __future__ import annotations

import json
import os
import sys
import time

from specaudit.plans import all_builders
from specaudit.session import local_session

HEADLINE = [
    "latest_results", "failures_summary", "column_eval_summary", "run_compare", "validate_eval", "run_snapshot_build",
    "dimension_gaps", "binding_targets", "text_sites", "constraint_audit", "column_history", "downstream_closure", "cycle_components",
    "topo_wave", "components", "staleness", "assertion_coverage", "matter_overview", "find_refs", "lint_synonym",
    "lint_markdown", "lint_dead_reference", "text_rule_scan", "concept_divergent_rules", "similar_name_links",
    "name_cluster_confidence", "near_duplicate_texts", "previous_snapshot_diff", "docset_freshness", "register_findings",
    "parse_rules", "pair_rules", "former_name_mentions", "merge_columns", "build_export", "import_export", "union_findings",
    "stream_open_failures", "stream_activity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_ONLY"].split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    builders = all_builders()
    builders["status_counts"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        builders[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
