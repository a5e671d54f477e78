"""Times headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from reviewloom import catalog

HEADLINE = (
    "pr_decision",
    "top_findings",
    "findings_by_file",
    "incremental_lint_scope",
    "merge_one_round",
    "open_issues",
    "review_rounds",
    "score_carry_forward",
    "language_detect",
    "rule_scan",
    "lookahead_scan",
    "secret_scan",
    "lint_report_eslint",
    "lint_report_checkstyle",
    "lint_report_cppcheck",
    "response_parse",
    "response_issues",
    "prompt_full",
    "prompt_incremental",
    "report_assembly",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("reviewloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["pr_decision"](spark, sf_dir).count()  # starts the JVM's code paths
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # The no-op sink computes every column of every row.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
