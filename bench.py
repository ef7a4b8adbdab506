"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

All queries are run once to warm up; each is then timed as the median of three runs. A run builds the
DataFrame, which for loads includes the writing, and forces every row with a ``noop`` write.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from tarnlake.session import build_session
from tarnlake.sources.scratch import clear_application

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "w1_segment_headcount_avg",
    "w2_daily_gmv_first10",
    "w3_table_counts",
    "w4_total",
    "g4_grouped_sum",
    "o1_sort_ascending",
    "o2_sort_by_rounded_alias",
    "u1_bag_union",
    "p1_all_columns",
    "p5_round_half_up",
    "s4_parquet_roundtrip",
    "s5_partitioned_roundtrip",
    "s6_orc_roundtrip",
    "g6_group_by_partition_column",
    "w2_monthly_gmv_first10_stored",
    "w5_smoke_round_trip",
    "w6_partitions",
    "s2_append_twice",
    "s3_append_static_partition",
    "r1_replace_load",
    "r2_replace_partitions",
    "r3_sync_plan",
    "r3_sync_copy",
    "r4_publish",
    "r5_row_count_audit",
    "r6_partition_inventory",
    "r7_domain_violations",
    "r7_domain_violations_many_columns",
    "r8_formula_violation_count",
    "r8_formula_violations",
    "r9_orphan_keys",
    "r9_orphan_rows",
    "r10_partition_key_audit",
    "r10_late_shipments",
    "r11_duplicate_keys",
    "r12_table_diff",
    "r12_table_diff_repeated_keys",
    "r13_compaction",
    "r14_typed_text_dates",
    "r14_typed_report",
]


def main() -> None:
    settings = {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tarnlake-bench-"),
    }
    spark = build_session("tarnlake-bench", f"local[{CPUS}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")

    from tarnlake.plans import QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
    for name in HEADLINE:
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    clear_application(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
