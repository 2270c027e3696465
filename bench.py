"""Headline timings: one JSON line, seconds per query at $BENCH_SF_DIR.

Stage tables (label lines, words, evidence, rule results) are timed as queries
of their own, so a query that reads one is not charged for building it.
"""

from __future__ import annotations

import json
import os
import time

from labelscope.plans import queries as Q
from labelscope.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
STAGES = {
    "stage_label_lines": Q.label_lines, "stage_words": Q.words, "stage_evidence": Q.evidence,
    "stage_rule_results": Q.results, "stage_table_blocks": Q.table_members,
}
HEADLINE = [
    "line_context", "label_value_candidates", "detections_to_lines", "table_pairs", "unit_resolution",
    "fuzzy_labels", "descriptor_scores", "descriptor_scores_text", "consumer_care_text", "dates_text",
    "declarations", "scan_scores", "violations", "audit_matrix", "csv_findings", "labelled_case_eval",
    "compliance_kpis", "daily_trend", "category_compliance", "history_upsert", "manifest_check",
]


def main() -> None:
    spark = local_session(CPUS, "labelscope-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    registered = Q.queries()
    seconds = {}
    for name, build in STAGES.items():
        start = time.time()
        build(spark, FOLDER)
        seconds[name] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        registered[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scans = Q.label_lines(spark, FOLDER).select("scan_id").distinct().count()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "scans": scans, "scans_per_sec_extraction": round(scans / seconds["stage_evidence"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
