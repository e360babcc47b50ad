"""Headline queries, timed: prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query is run once untimed, for planning and class loading, and then
BENCH_RUNS times (default 1) into a sink that keeps nothing; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tablekit.plans.catalog import QUERIES
from tablekit.session import local_session

HEADLINE = (
    "agg1_group_by", "agg6_pivot_sum", "agg13_median", "joi1_inner", "joi2_left", "flt2_comparisons", "srt1_sort",
    "dif1_table_diff", "dif3_diff_summary", "dif12_line_diff", "prf1_column_profile", "prf3_top_frequencies",
    "prf6_document_metrics", "prf7_schema_paths", "prf15_page_profile", "cln3_dedup_by_key", "cln6_fill_missing",
    "val2_required", "val7_unique", "val13_schema_objects", "jsn1_node_table", "jsn9_flatten", "jsn14_jsonpath",
    "dif5_json_diff", "fin6_by_month", "cln14_statement_clean", "snk10_ofx", "src9_read_qif", "geo2_wkt",
    "fx2_numbers", "imp5_group_median", "xml3_to_json",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tablekit-bench")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    total = round(sum(took.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
