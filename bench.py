"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2).
Each query is built and run to a full result once for warm-up, then timed; the median
counts. Stored intermediate tables are part of the timing.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from storelens.plans.queries import QUERIES
from storelens.session import release

HEADLINE = (
    "audit_report",
    "audit_reconcile",
    "order_mart",
    "orders_enriched",
    "review_monthly",
    "kpi_headline",
    "kpi_repeat_rate",
    "sales_by_state",
    "category_items_top10",
    "payments_by_type",
    "late_vs_review",
    "category_quality",
    "state_score_residual",
    "first_order_compare",
    "installments_items",
    "freight_ratio_by_category",
    "order_corr_matrix",
    "rfm_ntile",
    "rfm_summary",
    "clv_summary",
    "cohort_retention",
    "pareto_customer_top20",
    "seasonality_5mo",
    "voucher_repeat_rate",
    "rfm_kmeans_profile",
    "one_hot_features",
    "class_weights",
    "model_features",
    "split_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("storelens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
            release(spark)
        times[name] = round(statistics.median(measured[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
