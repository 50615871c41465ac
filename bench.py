"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Every query is executed completely with the ``noop`` sink (no collection to
the driver); the total is the sum of the per-query wall times. Before timing,
each headline query runs once on the smallest tables so JIT compilation,
class loading and Python worker start-up are not billed to the first query
that touches a code path.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bizlens.plans import QUERIES  # noqa: E402
from bizlens.session import get_session  # noqa: E402

HEADLINE = [
    "sales_kpis",
    "sales_top_products",
    "marketplace_kpis",
    "marketplace_pareto",
    "inventory_low_stock",
    "customer_kpis",
    "customer_high_ltv",
    "compare_product",
    "business_insights",
    "sales_daily",
    "sales_monthly",
    "anomaly_daily_iqr",
    "forecast_kpis",
    "forecast_seasonal",
    "profile_shape",
    "profile_duplicates",
    "profile_describe",
    "insights_all",
    "corr_matrix",
    "role_map",
    "chart_agg_median",
    "chart_pie_other",
    "chart_heatmap",
    "chart_histogram",
    "chart_box_stats",
    "chart_value_counts",
    "slice_kpis",
    "slice_top20",
    "ml_scaled",
    "pca_2d",
    "knn_distance",
    "silhouette_labels",
    "cluster_explain",
    "anomaly_isolation_forest",
    "ledger_latest_n",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="bizlens-bench")
    # warm-up on the smallest tables; not timed
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.environ.get("BENCH_WARMUP", "1") == "1":
        for name in names:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
